"""Analyst queries: free SQL over the tables and the look-back of an alert."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from embertrace.config import EngineConfig
from embertrace.functions.common import bucket_of


class NotAQuery(ValueError):
    """The text is not one read-only query."""


def register_tables(tables: dict[str, DataFrame]) -> None:
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


#: Kinds of plan nodes without children that read nothing, and of expressions that call arbitrary code.
_HARMLESS_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}
_FOREIGN_CODE = {"CallMethodViaReflection", "TryReflect", "PythonUDF", "ScalaUDF"}


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _refuse_foreign(plan) -> None:
    """Walk an analysed plan: all it reads must be registered views, and no outside code may run in it."""
    kind = plan.getClass().getSimpleName()
    if kind == "View":
        if not plan.isTempView():
            raise NotAQuery("only the registered tables may be read")
        return
    if "ScriptTransformation" in kind:
        raise NotAQuery("scripts are not permitted")
    children = [*_items(plan.children()), *(_items(plan.cteDefs()) if kind == "WithCTE" else [])]
    if not children and kind not in _HARMLESS_LEAVES:
        raise NotAQuery(f"only the registered tables may be read, not {plan.simpleStringWithNodeId()[:80]}")
    for expression in _items(plan.expressions()):
        _refuse_code(expression)
    for child in children:
        _refuse_foreign(child)


def _refuse_code(expression) -> None:
    kind = expression.getClass().getSimpleName()
    if kind in _FOREIGN_CODE:
        raise NotAQuery(f"{expression.prettyName()} is not permitted")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _refuse_foreign(expression.plan())
    for child in _items(expression.children()):
        _refuse_code(child)


def investigate_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Run one SELECT (or WITH ... SELECT) over the registered tables.

    The text must also be valid inside ``SELECT * FROM ( ... )``. Spark's parser
    refuses commands and several statements there, so nothing is matched by
    hand. The original text is what runs: a wrapper may lose its ORDER BY. Its
    analysed plan may read registered views only, and run no script, Java
    method or user function.
    """
    text = sql.strip().removesuffix(";").strip()
    if not text:
        raise NotAQuery("the query is empty")
    try:
        spark.sql(f"SELECT * FROM (\n{text}\n)", args=args).schema
        chosen = spark.sql(text, args=args)
    except PySparkException as problem:
        raise NotAQuery(f"only a single SELECT is permitted: {problem}") from problem
    _refuse_foreign(chosen._jdf.queryExecution().analyzed())
    return chosen


def entity_alerts_since(alerts: DataFrame, entity_name: str, since: datetime) -> DataFrame:
    """Alerts of an entity from a moment on, oldest first."""
    chosen = alerts.filter((F.col("entity_name") == entity_name) & (F.col("timestamp") >= F.lit(since)))
    return chosen.orderBy("timestamp", "alert_id")


def lookback_context(alerts: DataFrame, config: EngineConfig) -> DataFrame:
    """How many alerts and distinct rules the look-back of each alert holds.

    The look-back ends at the alert itself. Rows are placed in buckets as wide
    as the look-back and repeated into the next one, so a window never spans
    more than two buckets of an entity and no pairs are formed.
    """
    width = config.lookback_minutes * 60_000_000
    own = bucket_of("t", width)
    placed = alerts.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    window = Window.partitionBy("entity_name", "_bucket").orderBy("t").rangeBetween(-width, 0)
    return (
        placed.withColumns({
            "lookback_alerts": F.count("*").over(window),
            "lookback_rules": F.size(F.collect_set("rule_title").over(window)),
        })
        .filter(F.col("_bucket") == F.col("_own"))
        .drop("_own", "_bucket")
    )
