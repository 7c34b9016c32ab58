"""Exact n-gram Jaccard join with a token-group matrix, down to connected components.

A document is the set of its word n-grams (64-bit hashes). Documents with equal sets form a class; one stands for all.

1. *Groups.* Similar classes are gathered: classes that agree in one of a few minimum hashes are compared with the
   smallest of them, and those within the threshold join its group, transitively. Members of a group are connected already.
2. *Matrix.* Each document has a prefix: its rarest tokens, as many as leave too few others for a match
   (n - ceil(t n) + 1), so two documents within the threshold share a prefix token. The matrix holds, per token, the
   groups whose members have it in their prefix, without repetition, and per group the union of all its members' tokens, as a
   bitmap. A token held by one group only opens nothing; near all tokens are of that kind and go after one partial
   aggregation.
3. *Opening.* Of two groups with a token in common, the smaller one's members ask the larger. What of a member's tokens lies
   outside the group's union bounds their overlap; only groups that can reach the threshold open, and only members
   whose own bitmaps, sizes and token positions leave room are compared; two single documents also need as many common
   prefix tokens as the threshold leaves to the prefix. Groups open in rounds, a few members first;
   groups that prove linked become one, and need no more comparisons.
4. *Verification* compares both token sets in full. A set goes to its partners once, in front of them; no text travels, and no
   row holds a pair of sets. Links and groups give the components.

Tokens are ordered by frequency, frequent last, as counted over all documents: every class gives one in eight of its tokens, and which
ones depends on the class, so a token of many classes is met in about an eighth of them. The most frequent ``ranked_tokens`` of those that
several groups hold rank by their counts, all others by hash. Any order gives the same result; it decides only how many
comparisons step 3 makes. Nothing is capped.

Tables of a step are deleted once the next ones are written, so the disk holds the documents' classes, the prefixes or what was opened of them,
and one step's shuffles.

Defined results: null or empty texts, or texts without words, have 0 shingles and a component of their own; fewer than
``n`` words form one shingle; equal rows and equal texts are linked; a null id never becomes a component's id unless the component
has no other; an empty table gives an empty result; extra columns are not read. Texts are processed whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from embertrace.llm.common import gram_hashes, map_batches, mixed, restored, sheltered, text_bytes, word_hashes
from embertrace.llm.components import components
from embertrace.llm.skew import join_frequent
from embertrace.staging import discard, stage

MIN_HASHES = 4
#: One token in so many is probed for its frequency.
PROBE_SHARE = 8
#: Most tokens whose frequency counts in the order: 16 bytes each, sent to every task.
RANKED_TOKENS = 1 << 19
#: Most rows of a table that is broadcast by hint: 24 bytes each.
BROADCAST_ROWS = 200_000
FILTER_SLOTS = 1 << 22
#: Members of a group that the first round opens per token.
OPENED_MEMBERS = 4
#: Words of the bitmap of a document's tokens; of a group's, the union. Only bounds depend on it.
BITMAP_WORDS = 8
#: Pairs of one document that a task compares.
PAIRS_A_TASK = 1000
_BITS = [f"bits_{i}" for i in range(BITMAP_WORDS)]


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text, lower-cased in A-Z."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(n, len(words))))


def token_bits(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of BITMAP_WORDS 64-bit words with the bit of every token set."""
    table = np.zeros(64 * BITMAP_WORDS, bool)
    table[((tokens >> np.uint64(20)) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64)] = True
    return np.packbits(table).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, exactly."""
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _shingled(docs: DataFrame, n: int) -> DataFrame:
    """One row per document: doc_id, text_key, n, class (128-bit hash of the set), min hashes, the bitmap of all tokens, and
    the probe: one token in PROBE_SHARE, chosen by token and set."""

    def run(batches):
        from xxhash import xxh3_128_digest

        seeds = [np.uint64(0x1000193 * (k + 1)) for k in range(MIN_HASHES)]
        for batch in batches:
            rows: dict[str, list] = {"n": [], "class": [], "keys": [], "probe": [], "bits": []}
            for text in batch.column(2).to_pylist():
                tokens = shingle_set(text, n)
                rows["n"].append(len(tokens))
                rows["bits"].append(token_bits(tokens))
                if not len(tokens):
                    rows["class"].append(None)
                    rows["keys"].append([])
                    rows["probe"].append([])
                    continue
                name = xxh3_128_digest(tokens.tobytes())
                rows["class"].append(name)
                rows["keys"].append([int(mixed(tokens ^ s).min().view(np.int64)) for s in seeds])
                chosen = mixed(tokens ^ np.frombuffer(name, np.uint64)[0]) % np.uint64(PROBE_SHARE) == 0
                rows["probe"].append(tokens[chosen].view(np.int64))
            yield {"doc_id": batch.column(0), "text_key": batch.column(1), **rows}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    spec = "doc_id:long, text_key:long, n:long, class:binary, keys:longs, probe:longs, bits:longs"
    return stage(map_batches(source, spec, run), "shingled")


def _token_ranks(classes: DataFrame, groups: DataFrame, ranked_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several groups that most probes hold (sorted), and in how many probes each is.

    Counts go over the probes of all classes. Levels of frequency, four per doubling, are taken from the top while they have
    at most ``ranked_tokens`` tokens together; rarer tokens rank alike, so no more than these reach the driver.
    """
    probes = _with_group(classes.select("class", "probe"), groups, "class")
    probes = probes.select(F.xxhash64("gid").alias("group"), F.explode("probe").alias("token"))
    held = probes.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("seen"))
    held = held.filter("low <> high").select("token", "seen", F.floor(4 * F.log2("seen")).alias("level"))
    held = stage(held, "probed")
    least, total = None, 0
    for level, tokens in sorted(held.groupBy("level").count().collect(), reverse=True):
        total += tokens
        if total > ranked_tokens:
            break
        least = level
    if least is None:
        discard(held)
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    top = held.filter(F.col("level") >= least).select("token", "seen").toArrow()
    discard(held)
    token, seen = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], seen[order]


def _prefixes(docs: DataFrame, n: int, percent: int, ranks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``class, n, prefix`` of every document with words: its first tokens, rare ones first."""
    known, seen = ranks

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows: dict[str, list] = {"class": [], "n": [], "prefix": []}
            for text in batch.column(0).to_pylist():
                tokens = shingle_set(text, n)
                size = len(tokens)
                if not size:
                    continue
                rank = np.zeros(size, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    rank = np.where(known[at] == tokens, seen[at], 0)
                length = size - (size * percent + 99) // 100 + 1
                rows["class"].append(xxh3_128_digest(tokens.tobytes()))
                rows["n"].append(size)
                rows["prefix"].append(tokens[np.argsort(rank, kind="stable")[:length]].view(np.int64))
            yield rows

    return stage(map_batches(docs.select(text_bytes()), "class:binary, n:long, prefix:longs", run), "prefixes")


def _opened_rows(prefixes: DataFrame, shared: DataFrame) -> DataFrame:
    """``token, class, n, place`` of all prefix tokens in ``shared`` (column token).

    Most prefix tokens are in no other group. A table of one bit per slot of the hash keeps them from being
    shuffled; what it lets through by chance falls to the join. With too many shared tokens for such a table, all are joined.
    """
    slots = FILTER_SLOTS
    if shared.count() > slots // 4:
        rows = prefixes.select("class", "n", F.posexplode("prefix").alias("place", "token"))
        return rows.select("token", "class", "n", F.col("place").cast("long").alias("place")).join(shared, "token")
    slot = F.pmod(F.shiftrightunsigned("token", 7), F.lit(slots)).cast("int")
    table = np.zeros(slots, bool)
    table[shared.select(slot.alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    packed = np.packbits(table)

    def run(batches):
        open_ = np.unpackbits(packed).view(bool)
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            token = lists.flatten().to_numpy()
            kept = np.flatnonzero(open_[(token.view(np.uint64) >> np.uint64(7)).astype(np.int64) % slots])
            row = np.repeat(np.arange(len(lengths)), lengths)[kept]
            place = kept - (np.cumsum(lengths) - lengths)[row]
            yield {"token": token[kept], "class": batch.column(0).take(pa.array(row)), "n": batch.column(1).to_numpy()[row], "place": place}

    rows = prefixes.select("class", "n", "prefix")
    return map_batches(rows, "token:long, class:binary, n:long, place:long", run).join(shared, "token")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The stored pairs (a, b) of classes whose token sets are within the threshold, stored.

    The set of b stands once before those of its partners, in as many salted places as it has thousands of them; the task
    holds this one set. No row holds two sets, and none is repeated for each pair.
    """
    involved = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b"))).distinct().join(classes.select("class", "first_doc", "first_key"), "class")
    involved = stage(involved.select(F.col("class").alias("c"), F.col("first_doc").alias("d"), F.col("first_key").alias("k")), "involved")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    met = source.join(_small(involved), (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))

    def shingles(batches):
        for batch in batches:
            yield {"class": batch.column(0), "tokens": [shingle_set(t.as_py(), n).tobytes() for t in batch.column(1)]}

    sets = map_batches(met.select(F.col("c").alias("class"), "text"), "class:binary, tokens:binary", shingles)
    sets = stage(sets.dropDuplicates(["class"]), "sets")
    discard(involved)
    heads = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows"))
    heads = stage(heads.withColumn("salts", F.ceil(F.col("rows") / PAIRS_A_TASK).cast("int")), "heads")
    salted = join_frequent(pairs, heads, ["b"], F.col("rows"), pairs.count())
    salted = salted.select("b", F.pmod(F.xxhash64("a"), F.col("salts").cast("long")).cast("int").alias("salt"), "a")
    partners = salted.join(sets.withColumnRenamed("class", "a"), "a").select("b", "salt", "a", "tokens")
    first = heads.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("a"))
    first = first.join(sets.withColumnRenamed("class", "b"), "b").select("b", "salt", "a", "tokens")
    together = first.unionByName(partners).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches):
        held = np.empty(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            for b, a, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(tokens, np.uint64)
                if a is None:
                    held = own
                elif similar(own, held, percent):
                    found_a.append(a)
                    found_b.append(b)
            yield {"a": found_a, "b": found_b}

    links = stage(map_batches(together.select("b", "a", "tokens"), "a:binary, b:binary", run), "links")
    discard(sets, heads)
    return links


def _small(table: DataFrame) -> DataFrame:
    """A table of a few numbers per row, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _size_fits(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(F.col(x), F.col(y)) >= percent * F.greatest(F.col(x), F.col(y))


def _with_group(rows: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """Add ``gid``: the group of a class, or the class itself. The table of groups is broadcast up to a checked size."""
    named = _small(groups.select(F.col("node").alias(column), "component"))
    joined = rows.join(named, column, "left")
    return joined.withColumn("gid", F.coalesce("component", column)).drop("component")


def _overlap(n: str, inner: str, outer: str) -> Column:
    """At most so many tokens of a set of ``n`` with bitmap ``inner`` are in one with bitmap ``outer``: each bit that only
    ``inner`` has is a token that the other lacks."""
    missing = [F.bit_count(F.col(f"{inner}{b}").bitwiseAND(F.bitwise_not(F.col(f"{outer}{b}")))) for b in _BITS]
    return F.col(n) - reduce(lambda x, y: x + y, missing)


def _named_bits(prefix: str) -> list[Column]:
    return [F.col(b).alias(prefix + b) for b in _BITS]


def _open_groups(opened: DataFrame, groups: DataFrame, links: DataFrame, classes: DataFrame, docs: DataFrame, n: int,
                 percent: int) -> DataFrame:
    """Groups after comparing members of different groups, in rounds.

    Of two groups that share a token of the matrix, the smaller one's members ask the larger one: the group opens for
    a member if the union of the group's tokens can hold enough of the member's. Of an open group, at most ``members`` members per
    token are compared, and only those whose own tokens can hold enough. Groups that turn out linked are one group in the next
    round, which spares all other pairs between them. The bound grows eightfold per round, and a round takes only tokens at which
    some group had more members than the last bound: rounds end when there are none. Pairs of single documents, which need
    several common tokens, all meet in the first round.
    """
    members, done, compared, total = OPENED_MEMBERS, None, [], classes.count()
    while True:
        grouped = stage(_with_group(classes.select("class", "n", *_BITS), groups, "class"), "grouped")
        unions = stage(grouped.groupBy("gid").agg(
            F.count(F.lit(1)).alias("members"), F.max("n").alias("largest"), F.min("n").alias("least"),
            *[F.bit_or(b).alias(f"u_{b}") for b in _BITS]), "unions")
        named = _with_group(opened, groups, "class")
        group = F.xxhash64("gid")
        held = named.groupBy("token").agg(F.min(group).alias("low"), F.max(group).alias("high")).filter("low <> high").select("token")
        order = Window.partitionBy("token", "gid").orderBy("place", "class")
        ranked = stage(named.join(held, "token").withColumn("member", F.row_number().over(order)).filter(
            F.col("member") <= members + 1), "ranked")
        asked = ranked.filter(F.col("member") <= members)
        # Bounds of queries against groups: one row per token, asking member and group.
        entries = join_frequent(asked.select("token", "gid").distinct(), unions, ["gid"], F.col("members"), total)
        queries = join_frequent(asked, unions.select("gid", "members"), ["gid"], F.col("members"), total)
        queries = queries.join(classes.select("class", *_named_bits("q_")), "class")
        queries = queries.select("token", F.col("gid").alias("gid_q"), F.col("members").alias("members_q"), F.col("class").alias("q"),
                                 F.col("n").alias("n_q"), F.col("place").alias("p_q"), *[f"q_{b}" for b in _BITS])
        smaller = (F.col("members_q") < F.col("members")) | ((F.col("members_q") == F.col("members")) & (F.col("gid_q") < F.col("gid")))
        fits = (100 * F.col("n_q") >= percent * F.col("least")) & (100 * F.col("largest") >= percent * F.col("n_q"))
        enough = 100 * _overlap("n_q", "q_", "u_") >= percent * F.col("n_q")
        open_ = queries.join(entries, "token").filter(smaller & fits & enough)
        open_ = open_.select("token", "gid", (F.col("members") == 1).alias("alone"), "q", "n_q", "p_q", *[f"q_{b}" for b in _BITS])
        # The open groups' members that share the token.
        inside = asked.join(classes.select("class", *_named_bits("m_")), "class").select(
            "token", "gid", F.col("class").alias("m"), F.col("n").alias("n_m"), F.col("place").alias("p_m"), *[f"m_{b}" for b in _BITS])
        needed = percent * (F.col("n_q") + F.col("n_m"))
        room = (100 + percent) * F.least(F.col("n_q") - F.col("p_q"), F.col("n_m") - F.col("p_m")) >= needed
        able = ((100 + percent) * _overlap("n_q", "q_", "m_") >= needed) & ((100 + percent) * _overlap("n_m", "m_", "q_") >= needed)
        met = open_.join(inside, ["token", "gid"]).filter(_size_fits("n_q", "n_m", percent) & (F.col("alone") | room) & able)
        # Between groups of one member all common prefix tokens are here, of which the first has room. Beyond them, at most the
        # rest of one set is common.
        rest = lambda n: F.ceil(percent * F.col(n) / 100) - 1
        least = F.ceil(needed / (100 + percent)) - F.greatest(rest("n_q"), rest("n_m"))
        pairs = met.groupBy(F.least("q", "m").alias("a"), F.greatest("q", "m").alias("b")).agg(
            F.count(F.lit(1)).alias("common"), F.max(F.when(F.col("alone"), least).otherwise(1)).alias("least"),
            F.max(room).alias("roomy"))
        pairs = pairs.filter("common >= least and roomy").select("a", "b")
        pairs = stage(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = links.unionByName(verified(pairs, classes, docs, n, percent))
            groups = components(links)
        # At any other token all members of all groups met.
        left = ranked.filter(F.col("member") > members).select("token").distinct()
        used = opened
        opened = stage(opened.join(left, "token", "left_semi"), "opened")
        discard(used, grouped, unions, ranked)
        compared.append(pairs)
        if opened.isEmpty():
            discard(opened, *compared)
            return groups
        done = reduce(DataFrame.unionByName, compared)
        members *= 8


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, ranked_tokens: int = RANKED_TOKENS) -> DataFrame:
    """``doc_id, text_key, n_shingles, class, component_id`` of every row of ``docs`` (doc_id, text)."""
    docs = sheltered(docs).select("doc_id", "text")
    shingled = _shingled(docs, n)
    first = F.min(F.struct("doc_id", "text_key"))
    classes = shingled.filter("n > 0").groupBy("class").agg(
        first.alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"),
        F.first("probe").alias("probe"))
    classes = stage(classes.select("class", "n", "keys", "probe", F.col("first.doc_id").alias("first_doc"), F.col("first.text_key").alias("first_key"),
                                   *[F.get("bits", i).alias(b) for i, b in enumerate(_BITS)]), "classes")
    placed = stage(shingled.select("doc_id", "text_key", "n", "class"), "classes-of-documents")
    discard(shingled)
    # Groups: each class against the smallest class with one of its minimum hashes.
    keyed = classes.select("class", "n", F.posexplode("keys").alias("which", "key"))
    leaders = keyed.groupBy("which", "key").agg(F.min(F.struct("class", "n")).alias("lead"), F.count(F.lit(1)).alias("rows"))
    leaders = leaders.filter("rows > 1").select("which", "key", F.col("lead.class").alias("b"), F.col("lead.n").alias("n_b"))
    near = keyed.join(leaders, ["which", "key"]).filter((F.col("class") != F.col("b")) & _size_fits("n", "n_b", percent))
    near = stage(near.select(F.col("class").alias("a"), "b").distinct(), "near")
    links = verified(near, classes, docs, n, percent)
    discard(near)
    groups = components(links)
    # Matrix: tokens of several groups.
    ranks = _token_ranks(classes, groups, ranked_tokens)
    whole, classes = classes, stage(classes.drop("keys", "probe"), "classes")
    discard(whole)
    prefixes = _prefixes(docs, n, percent, ranks)
    tokens = _with_group(prefixes, groups, "class")
    tokens = tokens.select(F.xxhash64("gid").alias("group"), F.explode("prefix").alias("token"))
    held = tokens.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    shared = stage(held.filter("low <> high").select("token"), "shared")
    # Equal documents repeat their class's rows.
    opened = stage(_opened_rows(prefixes, shared).dropDuplicates(["token", "class"]), "opened")
    discard(prefixes, shared)
    groups = _open_groups(opened, groups, links, classes, docs, n, percent)
    # Smallest id of each component, over all rows of all its classes.
    discard(classes)
    named = _with_group(placed.filter("n > 0").select("class", "doc_id"), groups, "class")
    smallest = stage(named.groupBy("gid").agg(F.min("doc_id").alias("smallest")), "smallest")
    found = _with_group(placed, groups, "class").join(smallest, "gid", "left")
    return found.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class",
                         F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of every component: the one with the smallest id (and text, if ids repeat)."""
    names, docs = docs.columns, sheltered(docs)
    found = stage(jaccard_components(docs, n, percent), "components-of-documents")
    held = found.filter("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first"))
    first = held.select(F.col("first.doc_id").alias("_doc"), F.col("first.text_key").alias("_key"))
    wordless = found.filter("n_shingles = 0").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    kept = stage(first.unionByName(wordless).distinct(), "kept")
    discard(found)
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    joined = keyed.join(kept, (F.col("_text_key") == F.col("_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left_semi")
    once = joined.dropDuplicates(["doc_id", "_text_key"])
    return once.select(*restored(once, names))
