"""Near duplicates among embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

Codes: a rotation is learned on a bounded sample so that the signs of the rotated principal components lose least
(alternating between signs and the orthogonal Procrustes rotation). Every vector then has a code of up to 64 bits, of which
nearly parallel vectors share most.

Retrieval: equal vectors of a label are one class. Classes that share half of their code are compared with the first
of them; verified links make groups, so that a cluster of near copies is one entry per bucket from here on. Codes are
then cut into four substrings, each with a table of its own; two groups meet if a substring differs in one bit at most
(seven differing bits never escape all four tables). Rerank: groups that meet, and every group with itself, are compared
in full with the original vectors in double precision, as products of blocks of ``block_rows`` vectors; a block pair gives one count per
vector and one link between groups at most. No pair of vectors is a row anywhere.

Bounds: the sample has at most ``sample`` vectors and alone decides the rotation; all rows are indexed. Classes with very
many copies, leaders and groups with very many members are few by counting and are joined by broadcast. What grows with the
square of a cluster is the number of block products, as links of every vector are to be counted.

Defined results: vectors that are null, zero, or hold null, NaN or infinity, and rows with a null label or id, link with nothing;
vectors of unlike lengths are never compared; repeated rows and rows of one id count each; the component is the smallest
id that can be reached; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from embertrace.llm.common import map_batches, sheltered
from embertrace.llm.components import components
from embertrace.llm.skew import join_frequent
from embertrace.llm.topk import usable
from embertrace.staging import stage

LEAST_COSINE = 0.98
SAMPLE = 20_000
ITERATIONS = 40
TABLES = 4
#: Two single vectors are reranked if their codes differ in so many bits at most.
RADIUS = 14
BLOCK_ROWS = 256
_SEED = 12


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def learn_rotation(sample: np.ndarray, bits: int = 64, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors to code components."""
    dims = sample.shape[1]
    bits = min(bits, dims)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    reduced = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((bits, bits)))[0]
    for _ in range(iterations):
        signs = np.where(reduced @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(reduced.T @ signs)
        turn = left @ right
    return mean, axes @ turn


def codes_of(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signs of the rotated vectors as 64-bit numbers."""
    mean, projection = model
    signs = (vectors - mean) @ projection >= 0
    weights = np.uint64(1) << np.arange(signs.shape[1], dtype=np.uint64)
    return (signs * weights).sum(axis=1, dtype=np.uint64)


def _models(sample: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A rotation per vector length of the sample."""
    by_length: dict[int, list[np.ndarray]] = {}
    for raw in sample:
        by_length.setdefault(len(raw), []).append(np.frombuffer(raw))
    return {n // 8: learn_rotation(unit_rows(np.vstack(rows))) for n, rows in by_length.items()}


CODED = "vec_id:long, label:string, dims:int, key:binary, code:long, vector:binary"


def _coded(rows: DataFrame, models: dict) -> DataFrame:
    """Each usable row with its class key (128 bits of label and vector) and code."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            labels = batch.column(1).to_pylist()
            codes = np.zeros(len(lengths), np.uint64)
            for dims in np.unique(lengths):
                which = np.flatnonzero(lengths == dims)
                vectors = unit_rows(values[starts[which][:, None] + np.arange(dims)])
                # A length that the sample missed has plain signs for a code.
                model = models.get(int(dims)) or (np.zeros(dims), np.eye(dims)[:, :64])
                codes[which] = codes_of(vectors, model)
            raw = [values[s: s + n].tobytes() for s, n in zip(starts, lengths)]
            yield {"vec_id": batch.column(0), "label": batch.column(1), "dims": lengths.astype(np.int32),
                   "key": [xxh3_128_digest(f"{x}:".encode() + r) for x, r in zip(labels, raw)], "code": codes.view(np.int64), "vector": raw}

    return stage(map_batches(rows, CODED, run), "coded-vectors")


def _sample(rows: DataFrame, size: int) -> list[bytes]:
    """At most about ``size`` vectors, chosen by their hash."""
    total = rows.count()
    if not total:
        return []
    share = min(1.0, size / total)
    chosen = rows.filter(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").limit(2 * size)
    return [np.asarray(x, float).tobytes() for x in chosen.toArrow().column(0).to_pylist()]


def _part(code: Column, which: int) -> Column:
    return F.shiftrightunsigned(code, 16 * which).bitwiseAND(F.lit(0xFFFF))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _star_links(classes: DataFrame, least: float, total: int) -> DataFrame:
    """Links (a, b) between classes and the first class that shares two of their four substrings."""
    halves = F.array(*[F.struct(F.lit(10 * i + j).alias("which"), (_part(F.col("code"), i) * 65536 + _part(F.col("code"), j)).alias("half"))
                       for i, j in combinations(range(TABLES), 2)])
    keyed = stage(classes.select("key", "label", "dims", "code", F.inline(halves)), "halves")
    bucket = ["label", "dims", "which", "half"]
    leaders = keyed.groupBy(*bucket).agg(F.min(F.struct("key", "code")).alias("lead"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    leaders = stage(leaders.select(*bucket, "rows", F.col("lead.key").alias("lead_key"), F.col("lead.code").alias("lead_code")), "leaders")
    met = join_frequent(keyed, leaders, bucket, F.col("rows"), 6 * total)
    near = met.filter((F.col("key") != F.col("lead_key")) & (_apart("code", "lead_code") <= RADIUS))
    near = stage(near.select(F.col("key").alias("a"), F.col("lead_key").alias("b")).distinct(), "near-vectors")
    heads = near.groupBy("b").agg(F.count(F.lit(1)).alias("rows"))
    heads = heads.join(classes.select(F.col("key").alias("b"), F.col("vector").alias("vector_b")), "b")
    own = near.join(classes.select(F.col("key").alias("a"), F.col("vector").alias("vector_a")), "a")
    both = join_frequent(stage(own, "near-own"), stage(heads, "near-heads"), ["b"], F.col("rows"), 6 * total)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = [bool(a @ b >= least) for a, b in (
                (unit_rows(np.frombuffer(x)[None])[0], unit_rows(np.frombuffer(y)[None])[0])
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))]
            chosen = pa.array(kept)
            yield {"a": batch.column(0).filter(chosen), "b": batch.column(1).filter(chosen)}

    return map_batches(both.select("a", "b", "vector_a", "vector_b"), "a:binary, b:binary", run)


def _meeting_groups(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of groups of which a substring differs in one bit at most.

    Of two substrings that differ in one bit, the one with a zero there asks with that bit set, so each pair of buckets
    meets once. Two groups of one code each must also be near by their whole codes.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("which"), _part(F.col("code"), i).alias("sub")) for i in range(TABLES)])
    bucket = ["label", "dims", "which", "sub"]
    entries = placed.select("gid", "label", "dims", "code", F.inline(parts)).groupBy(*bucket, "gid").agg(
        F.min("code").alias("code"), F.max("code").alias("last"))
    entries = stage(entries.withColumn("single", F.col("code") == F.col("last")).drop("last"), "table-entries")
    flips = F.array(F.col("sub"), *[F.when(F.col("sub").bitwiseAND(F.lit(1 << i)) == 0, F.col("sub") + (1 << i)) for i in range(16)])
    asked = entries.withColumn("probe", F.explode(F.filter(flips, lambda x: x.isNotNull())))
    asked = asked.select("label", "dims", "which", F.col("sub").alias("own"), F.col("probe").alias("sub"), F.col("gid").alias("gid_q"),
                         F.col("code").alias("code_q"), F.col("single").alias("single_q"))
    met = asked.join(entries, bucket).filter(
        (F.col("gid") != F.col("gid_q")) & ((F.col("own") != F.col("sub")) | (F.col("gid_q") < F.col("gid"))))
    near = met.filter(~(F.col("single") & F.col("single_q")) | (_apart("code", "code_q") <= RADIUS))
    return near.select(F.least("gid", "gid_q").alias("a"), F.greatest("gid", "gid_q").alias("b")).distinct()


COMPARED = "key:binary, n:long, a:binary, b:binary"


def _compared(pairs: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """Counts of links per class (key, n) and links between groups (a, b), from products of blocks."""
    side = lambda x: blocks.select(F.col("gid").alias(x), F.col("block").alias(f"block_{x}"), F.col("rows").alias(f"rows_{x}"))
    met = pairs.join(side("a"), ["a", "block_a"]).join(side("b"), ["b", "block_b"])

    def run(batches):
        for batch in batches:
            keys: list[bytes] = []
            counts: list[int] = []
            edges: list[tuple[bytes, bytes]] = []
            names = [batch.column(i).to_pylist() for i in range(4)]
            for i, (a, block_a, b, block_b) in enumerate(zip(*names)):
                left, right = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                same = a == b and block_a == block_b
                x = unit_rows(np.vstack([np.frombuffer(r["vector"]) for r in left]))
                y = x if same else unit_rows(np.vstack([np.frombuffer(r["vector"]) for r in right]))
                linked = x @ y.T >= least
                if same:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                found = [(left, linked @ np.array([r["copies"] for r in right]))]
                if not same:
                    found.append((right, np.array([r["copies"] for r in left]) @ linked))
                for rows, n in found:
                    keys += [r["key"] for r, m in zip(rows, n) if m]
                    counts += n[n > 0].tolist()
                if a != b:
                    edges.append((a, b))
            none_k, none_e = [None] * len(edges), [None] * len(keys)
            yield {"key": keys + none_k, "n": counts + none_k, "a": none_e + [e[0] for e in edges], "b": none_e + [e[1] for e in edges]}

    return stage(map_batches(met.select("a", "block_a", "b", "block_b", "rows_a", "rows_b"), COMPARED, run), "compared")


def _grouped(rows: DataFrame, groups: DataFrame, column: str, total: int) -> DataFrame:
    """Add ``gid``, the group of ``column`` or itself."""
    named = groups.select(F.col("node").alias(column), F.col("component").alias("gid"))
    joined = rows.join(named, column, "left")
    return joined.withColumn("gid", F.coalesce("gid", column))


def vector_links(embeddings: DataFrame, least: float = LEAST_COSINE, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings`` (vec_id, embedding, label)."""
    table = sheltered(embeddings, ("vec_id", "embedding", "label")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"))
    fit = F.coalesce(usable("embedding") & F.exists("embedding", lambda x: x != 0), F.lit(False))
    marked = table.withColumn("fit", fit & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    good = marked.filter("fit").select("vec_id", "label", "embedding")
    coded = _coded(good, _models(_sample(good, sample)))
    total = coded.count()
    classes = stage(coded.groupBy("key").agg(
        F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in ("label", "dims", "code", "vector")]), "vector-classes")
    groups = components(stage(_star_links(classes, least, total), "star-links"))
    placed = stage(_grouped(classes, groups, "key", total), "placed")
    sizes = placed.groupBy("gid").agg(F.count(F.lit(1)).alias("members"))
    sizes = stage(sizes.withColumn("n_blocks", F.ceil(F.col("members") / block_rows).cast("int")), "group-sizes")
    dealt = join_frequent(placed, sizes, ["gid"], F.col("members"), total)
    block = F.pmod(F.xxhash64("key"), F.col("n_blocks").cast("long")).cast("int").alias("block")
    blocks = dealt.select("gid", block, F.struct("key", "copies", "vector").alias("row")).groupBy("gid", "block").agg(
        F.collect_list("row").alias("rows"))
    blocks = stage(blocks, "vector-blocks")
    # Pairs of blocks: of groups that meet, and of each group of several classes with itself.
    size_of = lambda x: sizes.select(F.col("gid").alias(x), F.col("n_blocks").alias(f"n_{x}"))
    meeting = stage(_meeting_groups(placed), "meeting")
    across = meeting.join(size_of("a"), "a").join(size_of("b"), "b")
    within = sizes.filter("members > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b"), F.col("n_blocks").alias("n_a"),
                                                F.col("n_blocks").alias("n_b"))
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pairs = across.unionByName(within).withColumn("block_a", F.explode(steps("n_a"))).withColumn("block_b", F.explode(steps("n_b")))
    pairs = pairs.filter((F.col("a") != F.col("b")) | (F.col("block_a") <= F.col("block_b"))).select("a", "block_a", "b", "block_b")
    compared = _compared(pairs, blocks, least)
    # Components of groups.
    joined = components(compared.filter("a is not null").select("a", "b"))
    final = _grouped(placed.select("key", "copies", "smallest", F.col("gid").alias("group")), joined, "group", total)
    final = stage(final, "final-groups")
    named = stage(final.groupBy("gid").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("members")), "smallest-ids")
    links = compared.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    each = join_frequent(final, named, ["gid"], F.col("members"), total).join(links, "key", "left")
    each = stage(each.select("key", "copies", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "class-links")
    found = join_frequent(coded.select("vec_id", "key"), each, ["key"], F.col("copies"), total).select("vec_id", "n_links", "component_id")
    alone = marked.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
