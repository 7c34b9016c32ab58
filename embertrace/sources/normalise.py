"""Raw JSON records of several log formats to the event envelope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from embertrace.config import EngineConfig
from embertrace.functions.common import first_truthy
from embertrace.schemas import ENTITY_TYPES, EVENT_TYPES

# --- fixed values: where each envelope field is looked for, in order ---------
TIME_KEYS = ("timestamp", "TimeCreated", "time", "@timestamp", "eventTime")
NAME_KEYS = ("user", "username", "TargetUserName", "SubjectUserName", "src_user", "actor")
HOST_KEYS_OBSERVED = ("host", "hostname", "Computer", "source", "WorkstationName")
HOST_KEYS_DOCUMENTED = ("host", "hostname", "Computer", "WorkstationName")
AUTH_EVENT_IDS = ("4624", "4625", "4634", "4648", "4768", "4771")
PROCESS_EVENT_IDS = ("4688", "4689", "1")
NETWORK_EVENT_IDS = ("3", "5156", "5158")
REGISTRY_EVENT_IDS = ("4657", "12", "13", "14")
AUTH_WORDS = ("login", "logon", "auth", "password", "credential")
PROCESS_WORDS = ("process", "cmd", "powershell", "exec", "command")
NETWORK_WORDS = ("network", "connect", "socket", "dns", "http")
REGISTRY_WORDS = ("registry", "regedit", "hklm", "hkcu")
FILE_WORDS = ("file", "write", "read", "delete", "create")
# --- end of fixed values ------------------------------------------------------

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"
_DOTTED_QUAD = r"^\d{1,3}(\.\d{1,3}){3}$"
_BLOCKS = ("entity", "event", "mitre")


# Fields read by name. Domain differs from domain by case only, so it is taken
# from the map of all fields.
_NAMED = tuple(dict.fromkeys((
    *TIME_KEYS, *NAME_KEYS, *HOST_KEYS_OBSERVED, "domain", "severity", "Level", "event_type", "action", "EventType",
    "outcome", "EventID", "event_id", *_BLOCKS, "raw_payload",
)))
_BLOCK_FIELDS = {
    "entity": ("actor", "name", "type", "target", "host"),
    "event": ("type", "action", "severity", "outcome"),
    "mitre": ("technique_id", "tactic"),
}


def _strings(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def parse_records(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse the text once into named fields and once into the payload map.

    Adds ``_all`` (every field), ``_f`` (the fields looked for by name) and one
    struct per nested block.
    """
    parsed = records.withColumns({
        "_all": F.from_json(raw, "map<string,string>"), "_f": F.from_json(raw, _strings(_NAMED)),
    })
    blocks = {f"_{name}": F.from_json(F.col("_f")[name], _strings(_BLOCK_FIELDS[name])) for name in _BLOCKS}
    return parsed.withColumns(blocks)


def _field(name: str) -> Column:
    return F.col("_f")[name]


def time_text() -> Column:
    return first_truthy(*[_field(key) for key in TIME_KEYS])


def read_time(text: Column) -> Column:
    """ISO-8601 text as UTC; NULL where unreadable (B1)."""
    return F.when(text.rlike(_ISO_DATE), F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00"))))


def resolve_entity_name(fallback: Column) -> Column:
    entity = F.col("_entity")
    return first_truthy(
        entity["actor"], entity["name"], *[_field(key) for key in NAME_KEYS], F.concat(F.lit("unknown_"), fallback)
    )


def resolve_host(config: EngineConfig) -> Column:
    entity = F.col("_entity")
    if config.documented:
        return first_truthy(entity["target"], entity["host"], *[_field(key) for key in HOST_KEYS_DOCUMENTED])
    return first_truthy(entity["target"], *[_field(key) for key in HOST_KEYS_OBSERVED])


def infer_entity_type(explicit: Column, name: Column, host: Column) -> Column:
    return (
        F.when(explicit.isin(*ENTITY_TYPES), explicit)
        .when(name.rlike(_DOTTED_QUAD), "ip")
        .when(name == host, "host")
        .otherwise("user")
    )


def resolve_severity() -> Column:
    def stated(col: Column) -> Column:
        return F.when(~col.isin("", "0"), col)

    chosen = F.coalesce(stated(F.col("_event")["severity"]), stated(_field("severity")), stated(_field("Level")))
    return F.coalesce(chosen.try_cast("int"), F.lit(0))


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    # Plain substring searches: many times faster than one alternation pattern.
    return reduce(lambda a, b: a | b, [text.contains(word) for word in words])


def infer_event_type(event_id: Column, text: Column) -> Column:
    """Type from the Windows event id, else from words anywhere in the lower-cased
    record (B8)."""
    return (
        F.when(event_id.isin(*AUTH_EVENT_IDS), "auth")
        .when(event_id.isin(*PROCESS_EVENT_IDS), "process")
        .when(event_id.isin(*NETWORK_EVENT_IDS), "network")
        .when(event_id.isin(*REGISTRY_EVENT_IDS), "registry")
        .when(_mentions(text, AUTH_WORDS), "auth")
        .when(_mentions(text, PROCESS_WORDS), "process")
        .when(_mentions(text, NETWORK_WORDS), "network")
        .when(_mentions(text, REGISTRY_WORDS), "registry")
        .when(_mentions(text, FILE_WORDS), "file")
        .otherwise("other")
    )


def stated_event_type(config: EngineConfig) -> Column:
    """The type a record states. Observed semantics take a missing one as
    ``other``, which then is not inferred (B7)."""
    stated = first_truthy(F.col("_event")["type"], _field("event_type"))
    return stated if config.documented else F.coalesce(stated, F.lit("other"))


def windows_event_id(config: EngineConfig) -> Column:
    nested = F.get_json_object(_field("raw_payload"), "$.EventID") if config.documented else F.lit(None)
    return F.trim(F.coalesce(_field("EventID"), nested, _field("event_id"), F.lit("")))


def lifted_payload(config: EngineConfig) -> Column:
    """The record's own fields; documented semantics add those of ``raw_payload``."""
    if not config.documented:
        return F.col("_all")
    nested = F.from_json(_field("raw_payload"), "map<string,string>")
    extra = F.map_filter(nested, lambda key, _: ~F.map_contains_key(F.col("_all"), key))
    return F.when(
        _field("raw_payload").startswith("{"), F.coalesce(F.map_concat("_all", extra), F.col("_all"))
    ).otherwise(F.col("_all"))


def _bad_block() -> Column:
    """A block that is there but is not an object."""
    tests = [
        F.when(_field(name).isNull(), F.map_contains_key("_all", F.lit(name))).otherwise(~_field(name).startswith("{"))
        for name in _BLOCKS
    ]
    return tests[0] | tests[1] | tests[2]


def normalise(
    records: DataFrame, config: EngineConfig, raw: str = "raw", event_id: Column | None = None,
    index: Column | None = None, ingest_time: Column | None = None,
) -> DataFrame:
    """Envelope columns plus ``reject_reason`` for every raw record (A2).

    ``event_id`` defaults to a hash of the record; ``index`` names entities that
    have no name. ``ingest_time`` stands in for a missing time in observed
    semantics.

    Values used more than once get a column of their own: they are computed
    once, and each projection stays small enough for the JVM to compile.
    """
    identifier = F.sha2(F.col(raw), 256) if event_id is None else event_id
    fallback = identifier if index is None else index.cast("string")
    none = F.lit(None).cast("string")
    found = parse_records(records, raw).withColumns({
        "_id": identifier, "_time_text": time_text(), "_name": resolve_entity_name(fallback),
        "_host": resolve_host(config), "_stated": stated_event_type(config), "_number": windows_event_id(config),
    })
    resolved = found.withColumns({
        "_time": read_time(F.col("_time_text")),
        "_known": F.col("_stated").isin(*EVENT_TYPES),
        "_text": F.lower(raw),
        "_bad": _bad_block(),
    })
    missing = F.col("_time_text").isNull()
    time = F.col("_time")
    if ingest_time is not None and not config.documented:
        time = F.when(missing, ingest_time).otherwise(time)
    reason = (
        F.when(F.col("_all").isNull(), "not an object")
        .when(F.col("_bad"), "block is not an object")
        .when(~missing & F.col("_time").isNull(), "unreadable timestamp")
    )
    if config.documented:
        reason = reason.when(missing, "no timestamp")
    event, mitre = F.col("_event"), F.col("_mitre")
    return resolved.select(
        F.col("_id").alias("event_id"),
        time.alias("timestamp"),
        F.lit("replay").alias("source"),
        F.struct(
            F.col("_name").alias("name"),
            infer_entity_type(F.col("_entity")["type"], F.col("_name"), F.col("_host")).alias("type"),
            F.col("_host").alias("host"),
            first_truthy(_field("domain"), F.col("_all")["Domain"]).alias("domain"),
        ).alias("entity"),
        F.struct(
            F.when(F.col("_known"), F.col("_stated"))
            .otherwise(infer_event_type(F.col("_number"), F.col("_text"))).alias("type"),
            first_truthy(event["action"], _field("action"), _field("EventType")).alias("action"),
            resolve_severity().alias("severity"),
            first_truthy(event["outcome"], _field("outcome")).alias("outcome"),
        ).alias("event"),
        F.struct(
            mitre["technique_id"].alias("technique_id"), none.alias("technique_name"),
            mitre["tactic"].alias("tactic"), none.alias("tactic_id"), F.lit("Unknown").alias("chain_stage"),
        ).alias("mitre"),
        lifted_payload(config).alias("raw_payload"),
        reason.alias("reject_reason"),
    )


def accepted(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reject_reason").isNotNull())


def validate_events(events: DataFrame, config: EngineConfig) -> DataFrame:
    """Envelope rows with a ``problem`` column: missing or out-of-range fields (A3).

    Absent optional parts get their defaults: type ``other``, severity 0.
    """
    kind = F.coalesce(F.col("event.type"), F.lit("other"))
    problem = F.coalesce(
        F.when(F.col("event_id").isNull(), "event_id is missing"),
        F.when(F.col("timestamp").isNull(), "timestamp is missing"),
        F.when(F.col("source").isNull() | ~F.col("source").isin(*config.event_sources), "unknown source"),
        F.when(F.col("entity.name").isNull(), "entity name is missing"),
        F.when(F.col("entity.type").isNull() | ~F.col("entity.type").isin(*ENTITY_TYPES), "unknown entity type"),
        F.when(~kind.isin(*EVENT_TYPES), "unknown event type"),
    )
    event = F.struct(
        kind.alias("type"), F.col("event.action").alias("action"),
        F.coalesce(F.col("event.severity"), F.lit(0)).alias("severity"), F.col("event.outcome").alias("outcome"),
    )
    return events.withColumns({"event": event, "problem": problem})
