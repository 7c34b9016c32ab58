"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns. A prefix is named by a sum: every turn (with its depth) has a 128-bit hash,
and a node's key is the sum of the hashes up to its depth, word by word. Sums are taken per range partition and joined by
partition totals, so a conversation of any length is spread over tasks. Keys then give way to exact names: the smallest
conversation through a node and its depth, of which no two nodes share both.

Roll-up: subtree sums (leaves, tokens saved) are found by centroid decomposition. In each round every component of more
than ``component_nodes`` nodes is split at its centroid, the deepest node with half of the component below it: the
centroid's subtrees become components of their own, their totals are added to the nodes on the way from the centroid to
the component's top, and the rest stays a component. Components that are small enough are decomposed to the end in
one task each, in the same manner. Rounds are logarithmic in the nodes, whatever the depth of the trie; each is written
to the shared folder, so a lost executor repeats a round at most.

What a round needs to know: the size of every subtree inside its component (at first: per member conversation, the nodes
that it is the smallest through, at or below the node; later less what was cut off), the way to the top (the
centroid's own conversation up to it), and who is below the centroid (conversations through its children).

Bounds: nodes with very many members, and components with very many nodes, are few by counting, and are joined by
broadcast; groups are sums, combined before they are shuffled. The ids that end at a node are hashed as text pieces in order:
of a node where a third of all conversations end, one task sees a few long pieces.

Defined results: rows with a null conv_id take no part; null role and text are empty; null turns stand first; turns of one
number are ordered by role, then by the MD5 of their text; repeated rows are turns; text lengths are code points; very long
texts are only hashed; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from embertrace.llm.common import map_batches, partitions, range_staged, running_sum
from embertrace.llm.skew import join_frequent
from embertrace.staging import stage

COMPONENT_NODES = 4096
#: Conversation ids in one piece of text.
PIECE_IDS = 4096
_WORDS = ("w0", "w1", "w2", "w3")
_LIMIT = 1 << 32


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position (from 1), role, digest, chars`` of every turn, stored."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    slim = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"),
                       F.lit(1).alias("one"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = running_sum(range_staged(slim, order, "turns"), order, "one", "position", by=("conv_id",))
    return stage(placed.select("conv_id", F.col("position").cast("long").alias("position"), "role", "digest", "chars"), "positions")


def rebuilt_turns(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where each begins with the first turns of its family's first conversation.

    ``conv_id, depth, role, digest, chars`` per rebuilt turn. The number of turns taken over is below ``most``.
    """
    taken = (F.crc32(F.col("conv_id").cast("string")) % most).alias("taken")
    own = stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")), "conversations")
    base = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")
    convs = convs.select("conv_id", "n_own", "base", taken, F.coalesce("n_base", F.lit(0)).alias("n_base"))
    convs = stage(convs.withColumn("found", F.least("taken", "n_base")), "families")
    heads = turns.filter((F.col("position") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs.select("conv_id", "base", "taken"), "base").filter("position <= taken")
    lent = lent.select("conv_id", F.col("position").alias("depth"), "role", "digest", "chars")
    kept = join_frequent(turns, convs.select("conv_id", "n_own", "taken", "found"), ["conv_id"], F.col("n_own"), turns.count())
    kept = kept.filter("position > taken").select("conv_id", (F.col("position") - F.col("taken") + F.col("found")).alias("depth"),
                                                  "role", "digest", "chars")
    return convs.select("conv_id"), lent.unionByName(kept)


def _running(staged: DataFrame, values: tuple[str, ...], order: list[str], by: str) -> DataFrame:
    """``sum_<value>`` up to and with each row in ``order``, per ``by``; partitions sum their own rows (see running_sum)."""
    rows = Window.partitionBy("_part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = staged.groupBy("_part", by).agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", by, *[F.coalesce(F.sum(f"t_{v}").over(earlier), F.lit(0)).alias(f"b_{v}") for v in values])
    summed = staged.withColumns({f"o_{v}": F.sum(v).over(rows) for v in values}).join(before, ["_part", by])
    return summed.withColumns({f"sum_{v}": F.col(f"o_{v}") + F.col(f"b_{v}") for v in values})


def _key(low: Column, high: Column) -> Column:
    return F.shiftleft(F.pmod(low, F.lit(_LIMIT)), 32).bitwiseOR(F.pmod(high, F.lit(_LIMIT)))


def _named_paths(turns: DataFrame, root: int) -> DataFrame:
    """``conv_id, depth, owner, parent_owner, chars``: the nodes on each conversation's way, without the root, stored.

    A node is (owner, depth), owner being the smallest conversation through it.
    """
    hashed = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "digest"))
    words = {w: F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long") for i, w in enumerate(_WORDS)}
    slim = turns.withColumn("hash", hashed).select("conv_id", "depth", "chars", *[c.alias(w) for w, c in words.items()])
    summed = _running(range_staged(slim, [F.col("conv_id"), F.col("depth")], "paths"), _WORDS, ["depth"], "conv_id")
    keyed = stage(summed.select(
        "conv_id", "depth", "chars", _key(F.col("sum_w0"), F.col("sum_w1")).alias("k1"),
        _key(F.col("sum_w2"), F.col("sum_w3")).alias("k2")), "keys")
    owners = keyed.groupBy("k1", "k2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("members"))
    owners = stage(owners, "owners")
    named = stage(join_frequent(keyed, owners, ["k1", "k2"], F.col("members"), keyed.count()).select("conv_id", "depth", "owner", "chars"), "named")
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_owner"))
    first = F.when(F.col("depth") == 1, F.lit(root).cast("long")).otherwise(F.col("parent_owner"))
    return stage(named.join(above, ["conv_id", "depth"], "left").withColumn("parent_owner", first), "members")


def _ended(members: DataFrame, convs: DataFrame, root: int) -> DataFrame:
    """``conv_id, n_turns, n_nodes, owner, depth``: length, nodes it is the smallest through, and the node of its end."""
    last = members.groupBy("conv_id").agg(
        F.max("depth").alias("n_turns"), F.count_if(F.col("owner") == F.col("conv_id")).alias("n_nodes"),
        F.max_by("owner", "depth").alias("owner"))
    all_ = convs.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"),
        F.coalesce("owner", F.lit(root).cast("long")).alias("owner"))
    return stage(all_.withColumn("depth", F.col("n_turns").cast("long")), "ends")


def trie_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(nodes, members, ends) of the trie, or None if there are no conversations.

    Nodes: ``owner, depth, parent_owner, n_convs, n_children, chars, size`` with the size of their subtree.
    """
    root, total = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if root is None:
        return None
    members = _named_paths(turns, root)
    ends = _ended(members, convs, root)
    measured = join_frequent(members, ends.filter("n_turns > 0").select("conv_id", "n_turns", "n_nodes"), ["conv_id"],
                             F.col("n_turns"), members.count())
    below = F.least(F.col("n_turns") - F.col("depth") + 1, F.col("n_nodes"))
    counted = stage(measured.groupBy("owner", "depth").agg(
        F.max("parent_owner").alias("parent_owner"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.sum(below).alias("size")), "counted")
    spark = turns.sparkSession
    top = spark.createDataFrame([(root, 0, None, total, 0, counted.count() + 1)],
                                "owner long, depth long, parent_owner long, n_convs long, chars long, size long")
    nodes = counted.unionByName(top)
    children = counted.groupBy(F.col("parent_owner").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["owner", "depth"], "left").fillna(0, ["n_children"])
    return stage(nodes, "nodes"), members, ends


# --- roll-up -----------------------------------------------------------------------


def subtree_sums(parents: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree sums of each list of values of a tree by centroid decomposition; parents stand before their children."""
    n = len(parents)
    sums = [[0] * n for _ in values]
    size, piece = [0] * n, [0] * n
    waiting = [list(range(n))] if n else []
    while waiting:
        part = waiting.pop()
        top = part[0]
        if len(part) == 1:
            for own, out in zip(values, sums):
                out[top] += own[top]
            continue
        for v in part:
            size[v] = 1
        for v in reversed(part):
            if 2 * size[v] >= len(part):
                centre = v
                break
            size[parents[v]] += size[v]
        # Components below the centroid in order of its children; the rest is component 0.
        pieces: list[list[int]] = [[]]
        for v in part:
            if v == centre:
                continue
            if v != top and parents[v] == centre:
                piece[v] = len(pieces)
                pieces.append([v])
                continue
            piece[v] = piece[parents[v]] if v != top else 0
            pieces[piece[v]].append(v)
        below = [v for p in pieces[1:] for v in p]
        way, v = [centre], centre
        while v != top:
            v = parents[v]
            way.append(v)
        for own, out in zip(values, sums):
            total = own[centre] + sum(own[v] for v in below)
            for v in way:
                out[v] += total
        waiting += [p for p in pieces if p]
    return sums


_TOP = ["top_owner", "top_depth"]
_SUMS = ["leaves", "saved"]


def _finish(small: DataFrame) -> DataFrame:
    """``owner, depth, leaves, saved`` of components that one task each decomposes."""
    ordered = small.select(*_TOP, "owner", "depth", "parent_owner", *_SUMS).repartition(*_TOP).sortWithinPartitions(*_TOP, "depth")

    def solved(rows: list[tuple]) -> tuple[list, list, list, list]:
        place = {(r[2], r[3]): i for i, r in enumerate(rows)}
        parents = [-1, *(place[r[4], r[3] - 1] for r in rows[1:])]
        leaves, saved = subtree_sums(parents, [[r[5] for r in rows], [r[6] for r in rows]])
        return [r[2] for r in rows], [r[3] for r in rows], leaves, saved

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    for to, new in zip(out, solved(held)):
                        to += new
                    held = []
                held.append(row)
            yield dict(zip(("owner", "depth", *_SUMS), out))
        if held:
            yield dict(zip(("owner", "depth", *_SUMS), solved(held)))

    return map_batches(ordered, "owner:long, depth:long, leaves:long, saved:long", run)


def _split(large: DataFrame, members: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(components after one round, sums found): every component of ``large`` is split at its centroid."""
    half = large.filter(2 * F.col("size") >= F.col("nodes"))
    centres = stage(half.groupBy(*_TOP).agg(
        F.min_by(F.struct("owner", "depth", "size", "n_children"), "size").alias("c"), F.max("nodes").alias("nodes")).select(
        *_TOP, "nodes", F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")), "centres")
    inside = join_frequent(large.drop("nodes"), centres, _TOP, F.col("nodes"), total)
    # Conversations through a child of the centroid: all their nodes below it go to that child's component.
    child = inside.filter((F.col("parent_owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth") + 1))
    child = stage(child.select(*_TOP, "owner", "depth", F.col("size").alias("child_size"), "n_convs"), "children")
    through = join_frequent(members.select("conv_id", "owner", "depth"), child, ["owner", "depth"], F.col("n_convs"), total)
    branch = through.select(F.col("conv_id").alias("owner"), *_TOP, F.col("owner").alias("child_owner"),
                            F.col("depth").alias("child_depth"), "child_size")
    # The way from the centroid to the top is the way of the centroid's own conversation.
    ends = centres.select(*_TOP, F.col("c_owner").alias("conv_id"), "c_depth")
    way = members.select("conv_id", "owner", "depth").join(ends, "conv_id").filter("depth < c_depth and depth >= top_depth")
    tops = centres.filter("top_depth = 0 and c_depth > 0").select(F.col("top_owner").alias("owner"), F.lit(0).cast("long").alias("depth"))
    way = way.select("owner", "depth").unionByName(tops).withColumn("on_way", F.lit(True))
    marked = inside.join(branch, ["owner", *_TOP], "left").join(way, ["owner", "depth"], "left")
    cut = (F.col("depth") > F.col("c_depth")) & F.col("child_owner").isNotNull()
    centre = (F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth"))
    marked = stage(marked.withColumns({"cut": cut, "centre": centre}), "marked")
    sums = stage(marked.filter("cut or centre").groupBy(*_TOP).agg(
        F.max("c_owner").alias("c_owner"), F.max("c_depth").alias("c_depth"), *[F.sum(s).alias(s) for s in _SUMS],
        F.max("nodes").alias("nodes")), "sums")
    found = sums.select(F.col("c_owner").alias("owner"), F.col("c_depth").alias("depth"), *_SUMS)
    above = join_frequent(marked.filter("on_way").select(*_TOP, "owner", "depth"), sums.select(*_TOP, "nodes", *_SUMS), _TOP,
                          F.col("nodes"), total)
    found = found.unionByName(above.select("owner", "depth", *_SUMS))
    less = F.when(F.col("on_way"), F.col("c_size")).otherwise(0)
    parts = marked.filter("not centre").select(
        F.when(F.col("cut"), F.col("child_owner")).otherwise(F.col("top_owner")).alias("top_owner"),
        F.when(F.col("cut"), F.col("child_depth")).otherwise(F.col("top_depth")).alias("top_depth"),
        F.when(F.col("cut"), F.col("child_size")).otherwise(F.col("nodes") - F.col("c_size")).alias("nodes"),
        "owner", "depth", "parent_owner", "n_convs", "n_children", (F.col("size") - less).alias("size"), *_SUMS)
    return parts, found


def roll_up(nodes: DataFrame, members: DataFrame, component_nodes: int = COMPONENT_NODES) -> DataFrame:
    """``owner, depth, leaves, saved``: rows whose sums per node are its subtree's.

    ``nodes`` has the node's own ``leaves`` and ``saved``.
    """
    root, size = nodes.filter("depth = 0").select("owner", "size").first()
    first = [F.lit(v).cast("long").alias(n) for n, v in zip((*_TOP, "nodes"), (root, 0, size))]
    state = nodes.select(*first, "owner", "depth", "parent_owner", "n_convs", "n_children", "size", *_SUMS)
    total = members.count() + 1
    small, found = [], []
    while True:
        state = stage(state, "components-of-nodes")
        small.append(state.filter(F.col("nodes") <= component_nodes))
        large = state.filter(F.col("nodes") > component_nodes)
        if large.isEmpty():
            break
        state, sums = _split(large, members, total)
        found.append(sums)
    return reduce(DataFrame.unionByName, [_finish(reduce(DataFrame.unionByName, small)), *found])


def id_hashes(ends: DataFrame) -> DataFrame:
    """``owner, depth, ends_sha256``: the hash of the ids (``conv_id``) of each node, ascending, joined by commas."""
    keys = ["owner", "depth"]
    ranged = ends.select(*keys, "conv_id").repartitionByRange(partitions(ends.sparkSession), *keys, "conv_id")
    ranged = ranged.sortWithinPartitions(*keys, "conv_id").withColumn("part", F.spark_partition_id().cast("long"))

    def pieces(batches):
        for number, batch in enumerate(batches):
            owner, depth, ids, part = (c.to_pylist() for c in batch.columns)
            out: dict[str, list] = {n: [] for n in ("owner", "depth", "part", "number", "ids")}
            low = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or i - low == PIECE_IDS or (owner[i], depth[i]) != (owner[low], depth[low]):
                    for name, value in zip(out, (owner[low], depth[low], part[low], number * (1 << 32) + low, ",".join(map(str, ids[low:i])))):
                        out[name].append(value)
                    low = i
            yield out

    cut = map_batches(ranged, "owner:long, depth:long, part:long, number:long, ids:string", pieces)
    in_order = cut.repartition(*keys).sortWithinPartitions(*keys, "part", "number").select(*keys, "ids")

    def hashed(batches):
        current, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for owner, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (owner, depth):
                    if state is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = (owner, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield dict(zip(("owner", "depth", "ends_sha256"), zip(*done))) if done else {"owner": [], "depth": [], "ends_sha256": []}
        if state is not None:
            yield {"owner": [current[0]], "depth": [current[1]], "ends_sha256": [state.hexdigest()]}

    return map_batches(in_order, "owner:long, depth:long, ends_sha256:string", hashed)


NODE_COLUMNS = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                "saved_tokens long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, component_nodes: int = COMPONENT_NODES) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, depth from 1 without gaps, role, digest, chars).

    ``convs`` (conv_id) also lists conversations without turns. Tokens saved are the text's length for all members but one.
    """
    made = trie_nodes(turns, convs)
    if made is None:
        return turns.sparkSession.createDataFrame([], NODE_COLUMNS)
    nodes, members, ends = made
    own = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("chars"))
    none = F.lit(None)
    rolled = roll_up(own, members, component_nodes).select(
        "owner", "depth", *_SUMS, *[none.cast("long").alias(c) for c in ("parent_owner", "n_convs", "n_children")],
        none.cast("string").alias("ends_sha256"))
    facts = nodes.select("owner", "depth", *[F.lit(0).cast("long").alias(s) for s in _SUMS], "parent_owner", "n_convs",
                         "n_children", none.cast("string").alias("ends_sha256"))
    hashes = id_hashes(ends).select("owner", "depth", *[F.lit(0).cast("long").alias(s) for s in _SUMS],
                                    *[none.cast("long").alias(c) for c in ("parent_owner", "n_convs", "n_children")], "ends_sha256")
    empty = hashlib.sha256(b"").hexdigest()
    whole = rolled.unionByName(facts).unionByName(hashes).groupBy("owner", "depth").agg(
        F.max("parent_owner").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    return whole.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, component_nodes: int = COMPONENT_NODES) -> DataFrame:
    """The trie of the rebuilt conversations."""
    convs, turns = rebuilt_turns(ordered_turns(conversations))
    return prefix_trie(turns, convs, component_nodes)
