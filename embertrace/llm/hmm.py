"""Hidden Markov language model: Baum-Welch over all training documents, exact likelihoods by scaled forward recursion.

Words are counted over the training documents (every word, by 64-bit hash). Every word seen ``least_seen`` times or more has an
emission probability per latent state, however many there are. All others belong to a tail class per state; within it a word's
share is (c + 1) / (sum of (c + 1) over tail words + 1), the last 1 being for words never met. So the model is a proper
distribution over any words.

Words rank by count. Emissions and counts of the head of the ranks are broadcast; those of words beyond it stay in a table (word,
state, expected count), which joins the documents' words by hash in each round. The size of the head changes no result.

Training is distributed Baum-Welch: a task runs forward and backward over its documents (all documents of a block at
once, step by step) and hands on expected counts of starts, transitions and emissions, which Spark sums. The first
counts come from the documents' language, each language being tied to a state, or from a hash where there is none; rounds follow
until one gains less than ``tolerance`` in log10 likelihood a token. Emissions are smoothed towards the words' overall shares.

Scoring runs the scaled forward recursion over every document.

Defined results: a null or empty text is its end token alone; a null id is trained on and scored like others (its text form
for the split is empty); repeated rows count and score each; an empty table gives an empty result; without training documents all
words are unknown; extra columns are not read. A very long text is a block of its own, with the states of all its tokens (48 bytes each)
in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from embertrace.llm.common import map_batches, sheltered, text_bytes, word_hashes
from embertrace.staging import discard, shuffles_removed, stage

#: The end token. It holds white space, so no word equals it.
END_WORD = b"\x00 end"


@dataclass(frozen=True)
class HmmConfig:
    states: int = 6
    #: Rounds go on while one gains this much in log10 likelihood a token.
    tolerance: float = 1e-3
    #: Words whose emissions are broadcast, at most; those of others are joined.
    state_words: int = 1 << 20
    #: Rarer words stay in the tail, whose share also covers words never met.
    least_seen: int = 5
    #: Words whose counts are broadcast, at most; the head is the smaller of the two.
    head_words: int = 1 << 20
    #: Tokens that a task runs forward and backward over at once; documents stay whole.
    block_tokens: int = 1 << 18
    #: Pseudo-counts of the overall shares in each state's emissions, and of each transition.
    smoothing: float = 200.0
    stay: float = 50.0


def _tokens(text: bytes) -> np.ndarray:
    return word_hashes([*text.lower().split(), END_WORD])


# --- counts ------------------------------------------------------------------------------


def split(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, text, held_out``; held out are ids whose crc32 as text is 2 modulo 7."""
    docs = sheltered(docs)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_bytes().alias("text"),
                       (remainder == 2).alias("held_out"))


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, seen`` of the training rows; words as 64-bit hashes."""

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held += [_tokens(t) for t in batch.column(0).to_pylist()]
            if sum(map(len, held)) > 1 << 21:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    def counted(held):
        word, seen = np.unique(np.concatenate(held), return_counts=True)
        return {"word": word.view(np.int64), "seen": seen}

    training = rows.filter(~F.col("held_out")).select("text")
    return stage(map_batches(training, "word:long, seen:long", run).groupBy("word").agg(F.sum("seen").alias("seen")), "word-counts")


class Vocabulary:
    """The head of the count table, by rank: ``words`` sorted by hash, with ``ranks``; ``seen`` by rank."""

    def __init__(self, counts: DataFrame, config: HmmConfig) -> None:
        named = F.col("seen") >= config.least_seen
        whole = counts.agg(F.sum("seen").alias("tokens"), F.count(F.lit(1)).alias("words"), F.count_if(named).alias("named"),
                           F.coalesce(F.sum(F.when(named, F.col("seen"))), F.lit(0)).alias("named_tokens")).first()
        self.tokens, self.distinct = whole["tokens"] or 0, whole["words"]
        # The least count of which all words fit into the head, from a histogram of logarithmic buckets.
        bucket = F.floor(F.log("seen") / np.log(1.02)).cast("int")
        histogram = sorted(counts.groupBy(bucket.alias("b")).count().collect(), reverse=True)
        room, least = min(config.head_words, config.state_words), None
        for b, n in histogram:
            if n > room:
                break
            room, least = room - n, b
        head = counts.filter(bucket >= least if least is not None else F.lit(False)).toArrow()
        words, seen = head.column(0).to_numpy().view(np.uint64), head.column(1).to_numpy()
        order = np.lexsort((words, -seen))
        self.seen = seen[order]
        by_hash = np.argsort(words[order])
        self.words, self.ranks = words[order][by_hash], by_hash.astype(np.int32)
        self.state_words = int((self.seen >= config.least_seen).sum())
        self.least = least
        #: Whether words beyond the head have emissions.
        self.wide = whole["named"] > self.state_words
        self.tail_weight = (self.tokens - whole["named_tokens"]) + (self.distinct - whole["named"]) + 1


def rank(words: np.ndarray, ranks: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Rank of each token, -1 beyond the head."""
    if not len(words):
        return np.full(len(tokens), -1, np.int32)
    at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
    return np.where(words[at] == tokens, ranks[at], np.int32(-1))


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per document: row, doc_id, lang, held_out, n_tokens, ranks (int32), far (hashes of words beyond the head)."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary.words, vocabulary.ranks))

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_tokens", "ranks", "far")}
            for text in batch.column(2).to_pylist():
                tokens = _tokens(text)
                ranks = rank(*shared.value, tokens)
                out["n_tokens"].append(len(tokens))
                out["ranks"].append(ranks.astype("<i4").tobytes())
                out["far"].append(tokens[ranks < 0].view(np.int64))
            n = batch.num_rows
            yield {"row": np.arange(number, number + n) + (part << 40), "doc_id": batch.column(0), "lang": batch.column(1),
                   "held_out": batch.column(3), **out}
            number += n

    spec = "row:long, doc_id:long, lang:string, held_out:boolean, n_tokens:long, ranks:binary, far:longs"
    return stage(map_batches(rows.select("doc_id", "lang", "text", "held_out"), spec, run), "encoded")


# --- the model ---------------------------------------------------------------------------


#: start (K), move (K x K), emit (classes x K; the last class is the tail). Plain arrays, as broadcasts need.
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def model_of(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, config: HmmConfig, beyond: np.ndarray | float = 0.0,
             words_beyond: int = 0) -> Model:
    """The model that expected counts give; ``beyond`` counts emissions per state of ``words_beyond`` words without a class."""
    k = config.states
    prior = np.ones((k, k)) + config.stay * np.eye(k)
    overall = emits.sum(axis=1) + 1e-3
    whole = overall.sum() + np.sum(beyond) + 1e-3 * words_beyond
    smooth = emits + config.smoothing * (overall / whole)[:, None]
    total = emits.sum(axis=0) + beyond + config.smoothing
    return (starts + 1) / (starts.sum() + k), (moves + prior) / (moves + prior).sum(axis=1, keepdims=True), smooth / total


def blocks(batches, columns: tuple[int, ...], ranks_at: int, config: HmmConfig, tail: int):
    """Documents in blocks of at most ``block_tokens`` and one document: (values of ``columns`` by column, ranks by document, :class:`Wide`).

    Documents of one batch are taken longest first, so that those of a block are about as long and share their steps.
    The columns after the ranks are those of :func:`with_wide`.
    """
    for batch in batches:
        lengths = pc.binary_length(batch.column(ranks_at)).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        order = np.argsort(-lengths, kind="stable")
        block = (np.cumsum(lengths[order]) - 1) // config.block_tokens
        for rows in np.split(order, np.flatnonzero(np.diff(block)) + 1):
            if not len(rows):
                continue
            part = batch.take(pa.array(rows))
            ranks = [np.frombuffer(r, "<i4") for r in part.column(ranks_at).to_pylist()]
            wide = list(zip(*(part.column(ranks_at + i).to_pylist() for i in range(1, 3 + config.states))))
            yield [part.column(c).to_pylist() for c in columns], ranks, Wide(ranks, wide, tail)


class Wide:
    """Words of a block whose emissions are not broadcast: ``words``, ``emit``; ``classes`` of all tokens by document."""

    def __init__(self, ranks: list[np.ndarray], rows: list[tuple], tail: int) -> None:
        found = [r[1:] for r in rows if r[1]]
        words = np.concatenate([np.array(f[0], np.int64) for f in found]) if found else np.empty(0, np.int64)
        self.words, first = np.unique(words, return_index=True)
        self.emit = np.stack([np.concatenate([np.array(x, float) for x in s])[first] for s in list(zip(*found))[1:]], axis=1) if found else None
        self.classes = []
        for own, row in zip(ranks, rows):
            classes = np.where((own < 0) | (own >= tail), tail, own).astype(np.int64)
            if row[1]:
                far = np.array(row[0], np.int64)
                at = np.minimum(np.searchsorted(self.words, far), len(self.words) - 1)
                classes[own < 0] = np.where(self.words[at] == far, tail + 1 + at, tail)
            self.classes.append(classes)
        self.top = tail + len(self.words)

    def model(self, model: Model) -> Model:
        """``model`` with the emissions of the block's own words."""
        return model if self.emit is None else (model[0], model[1], np.concatenate([model[2], self.emit]))


class Lattice:
    """Tokens of a block by step: all documents side by side, longest first, so that a step's documents are a prefix."""

    def __init__(self, ranks: list[np.ndarray], tail: int, top: int | None = None) -> None:
        top = tail if top is None else top  # classes above the tail are words of the block
        lengths = np.array([len(r) for r in ranks])
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(self.lengths[0])
        # Documents that have a token at each step.
        self.width = np.searchsorted(-self.lengths, -np.arange(steps), "left")
        self.begin = np.r_[0, np.cumsum(self.width)]
        step = np.concatenate([np.arange(n) for n in self.lengths])
        doc = np.repeat(np.arange(len(ranks)), self.lengths)
        flat = np.concatenate([ranks[i] for i in self.order])
        self.classes = np.empty(len(flat), np.int64)
        self.classes[self.begin[step] + doc] = np.where((flat < 0) | (flat > top), tail, flat)

    def forward(self, model: Model, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(log10 likelihood per document, states of all tokens or None, scales of all tokens)."""
        start, move, emit = model
        shares = emit[self.classes]
        scales = np.empty(len(self.classes))
        states = shares if keep else None
        score = np.zeros(len(self.lengths))
        # Sums over the few states of many documents are quicker as products.
        ones, begin, state = np.ones(len(start)), self.begin.tolist(), None
        for a, b in zip(begin, begin[1:]):
            held = shares[a:b]
            held *= start if state is None else state[: b - a] @ move
            scale = np.dot(held, ones, out=scales[a:b])
            held /= scale[:, None]
            state = held
        logs = np.log10(scales)
        doc = np.concatenate([np.arange(n) for n in self.width])
        score += np.bincount(doc, logs, len(score))
        return score, states, scales

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts (K), moves (K x K) and the states of all tokens; ``likelihood`` is kept, in log10."""
        _, move, emit = model
        score, states, scales = self.forward(model, keep=True)
        self.likelihood = float(score.sum())
        k = states.shape[1]
        ahead = emit[self.classes]
        ahead /= scales[:, None]
        moves, back = np.zeros((k, k)), np.ascontiguousarray(move.T)
        after = np.ones((len(self.lengths), k))
        begin = self.begin.tolist()
        for t in range(len(self.width) - 1, -1, -1):
            a, b = begin[t], begin[t + 1]
            n, own = b - a, after[: b - a]
            states[a:b] *= own
            if t:
                inner = ahead[a:b]
                inner *= own
                moves += states[begin[t - 1]: begin[t - 1] + n].T @ inner
                np.dot(inner, back, out=own)
        return states[: self.width[0]].sum(axis=0), moves * move, states


_HEAD, _MOVE, _START, _FAR, _LIKELIHOOD = range(5)


class _Counts:
    """Expected counts of a task's blocks, as rows (kind, number, s0, ...): emissions by class, or by word beyond the head; moves by
    state; starts. Those of the head are summed in the task, words beyond it leave with their block."""

    def __init__(self, tail: int, k: int) -> None:
        self.emits, self.moves, self.starts = np.zeros((tail + 1, k)), np.zeros((k, k)), np.zeros(k)
        self.likelihood = 0.0

    def add(self, lattice: Lattice, weights: np.ndarray, starts: np.ndarray, moves: np.ndarray, wide: Wide,
            likelihood: float = 0.0) -> Iterator[dict]:
        tail, k = len(self.emits) - 1, len(self.starts)
        self.moves += moves
        self.starts += starts
        self.likelihood += likelihood
        size = int(lattice.classes.max()) + 1
        sums = np.stack([np.bincount(lattice.classes, weights[:, s], size) for s in range(k)], axis=1)
        near = min(size, tail + 1)
        self.emits[:near] += sums[:near]
        met = np.flatnonzero(sums[near:].any(axis=1))
        if len(met):
            yield self._table(np.full(len(met), _FAR), wide.words[met], sums[near:][met])

    def rows(self) -> dict:
        k = len(self.starts)
        met = np.flatnonzero(self.emits.any(axis=1))
        said = np.zeros(k)
        said[0] = self.likelihood
        return self._table(np.r_[np.full(len(met), _HEAD), np.full(k, _MOVE), _START, _LIKELIHOOD], np.r_[met, np.arange(k), 0, 0],
                           np.concatenate([self.emits[met], self.moves, self.starts[None], said[None]]))

    @staticmethod
    def _table(kinds: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> dict:
        return {"kind": kinds, "number": numbers, **{f"s{s}": values[:, s] for s in range(values.shape[1])}}


def _summed(rows: DataFrame, vocabulary: Vocabulary, config: HmmConfig, held: list[DataFrame]) -> tuple[Model, DataFrame | None, float]:
    """The model, the table of emissions of words beyond the head, and the log10 likelihood under the model before.

    ``held`` has the stored table that ``rows`` read such emissions from, if any, and then the one that replaces it."""
    k, tail = config.states, vocabulary.state_words
    states = [f"s{s}" for s in range(k)]
    # A task's rows are sums already: summing them once more before the shuffle would gain nothing.
    sums = rows.repartition("kind", "number").groupBy("kind", "number").agg(*[F.sum(s).alias(s) for s in states])
    beyond, words_beyond, far = np.zeros(k), 0, None
    if vocabulary.wide:
        sums = stage(sums, "expected-counts")
        discard(*held)
        held[:] = [sums]
        far = sums.filter(F.col("kind") == _FAR)
        whole = far.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in states]).first()
        beyond, words_beyond = np.array([whole[s] for s in states]), whole["n"]
    with shuffles_removed(rows.sparkSession):
        near = sums.filter(F.col("kind") != _FAR).toArrow()
    kind, number = (near.column(i).to_numpy() for i in (0, 1))
    values = np.stack([near.column(2 + s).to_numpy() for s in range(k)], axis=1) if len(kind) else np.zeros((0, k))
    emits, moves = np.zeros((tail + 1, k)), np.zeros((k, k))
    emits[number[kind == _HEAD]] = values[kind == _HEAD]
    moves[number[kind == _MOVE]] = values[kind == _MOVE]
    starts = values[kind == _START].sum(axis=0)
    model = model_of(starts, moves, emits, config, beyond, words_beyond)
    if far is not None:
        overall = sum(F.col(s) for s in states) + 1e-3
        everything = float(emits.sum() + 1e-3 * len(emits) + beyond.sum() + 1e-3 * words_beyond)
        total = emits.sum(axis=0) + beyond + config.smoothing
        far = far.select(F.col("number").alias("word"), *[
            ((F.col(s) + config.smoothing * overall / everything) / float(total[i])).alias(s) for i, s in enumerate(states)])
    return model, far, float(values[kind == _LIKELIHOOD].sum())


def with_wide(docs: DataFrame, links: DataFrame | None, far: DataFrame | None, config: HmmConfig) -> DataFrame:
    """``docs`` (row, ..., ranks last) with columns far, wide words and their emissions per state (null without any)."""
    states = [f"s{s}" for s in range(config.states)]
    rest = [c for c in docs.columns if c != "far"]
    if links is None:
        none = F.lit(None)
        return docs.select(*rest, none.cast("array<bigint>").alias("far"), none.cast("array<bigint>").alias("wide"),
                           *[none.cast("array<double>").alias(s) for s in states])
    found = links.join(far, "word").groupBy("row").agg(F.collect_list(F.struct("word", *states)).alias("met"))
    return docs.join(found.withColumnRenamed("row", "met_row"), F.col("row") == F.col("met_row"), "left").select(
        *rest, "far", F.col("met.word").alias("wide"), *[F.col(f"met.{s}").alias(s) for s in states])


def train(docs: DataFrame, vocabulary: Vocabulary, config: HmmConfig, links: DataFrame | None = None
          ) -> tuple[Model, DataFrame | None]:
    """The model and emissions beyond the head that Baum-Welch over the training rows of :func:`encoded` converges to.

    ``links`` has the words beyond the head with emissions, by row.
    """
    k, tail = config.states, vocabulary.state_words
    spec = "kind:int, number:long, " + ", ".join(f"s{s}:double" for s in range(k))
    training = docs.filter(~F.col("held_out")).select("lang", "row", "ranks", "far")
    # Languages take states in order of their share, further ones and documents without one by hash.
    with shuffles_removed(docs.sparkSession):
        langs = training.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(k).collect()
    tied = {r["lang"]: s for s, r in enumerate(langs) if r["lang"] is not None}
    far = links.select("word").distinct().select("word", *[F.lit(1.0).alias(f"s{s}") for s in range(k)]) if links is not None else None

    def first(batches):
        counts = _Counts(tail, k)
        for (langs_, numbers), ranks, wide in blocks(batches, (0, 1), 2, config, tail):
            lattice = Lattice(wide.classes, tail, wide.top)
            state = np.array([tied.get(x, r % k) for x, r in zip(langs_, numbers)])[lattice.order]
            weights = np.full((len(ranks), k), 0.1 / k)
            weights[np.arange(len(ranks)), state] += 0.9
            doc = np.concatenate([np.arange(n) for n in lattice.width])
            yield from counts.add(lattice, weights[doc], weights.sum(axis=0), (weights * (lattice.lengths - 1)[:, None]).T @ weights, wide)
        yield counts.rows()

    held: list[DataFrame] = []
    model, far, _ = _summed(map_batches(with_wide(training, links, far, config), spec, first), vocabulary, config, held)
    before = None
    while vocabulary.tokens:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def maximise(batches, shared=shared):
            counts = _Counts(tail, k)
            for _, _, wide in blocks(batches, (), 2, config, tail):
                lattice = Lattice(wide.classes, tail, wide.top)
                starts, moves, states = lattice.expected(wide.model(shared.value))
                yield from counts.add(lattice, states, starts, moves, wide, lattice.likelihood)
            yield counts.rows()

        model, far, likelihood = _summed(map_batches(with_wide(training, links, far, config), spec, maximise), vocabulary, config, held)
        shared.unpersist()
        if before is not None and likelihood - before < config.tolerance * vocabulary.tokens:
            break
        before = likelihood
    return model, far


def hmm_scores(docs: DataFrame, config: HmmConfig = HmmConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text, lang)."""
    rows = split(docs)
    counts = word_counts(rows)
    vocabulary = Vocabulary(counts, config)
    documents = encoded(rows, vocabulary)
    links = None
    if vocabulary.wide:
        met = documents.select("row", F.explode(F.array_distinct("far")).alias("word"))
        links = stage(met.join(counts.filter(F.col("seen") >= config.least_seen).select("word"), "word"), "words-beyond")
    model, emissions = train(documents, vocabulary, config, links)
    tail, tokens, distinct = vocabulary.state_words, vocabulary.tokens, vocabulary.distinct
    spark = docs.sparkSession
    shared, seen = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(np.log10(vocabulary.seen + 1.0))

    def score(batches):
        for (numbers, ids, held), ranks, wide in blocks(batches, (0, 1, 2), 3, config, tail):
            lattice = Lattice(wide.classes, tail, wide.top)
            own = np.empty(len(ranks))
            own[lattice.order] = lattice.forward(wide.model(shared.value), keep=False)[0]
            known = [r[r >= 0] for r in ranks]
            yield {"row": numbers, "doc_id": ids, "held_out": held, "n_tokens": [len(r) for r in ranks],
                   "near_known": [len(r) for r in known], "logs": [float(seen.value[r].sum()) for r in known],
                   "tail_logs": [float(seen.value[r[r >= tail]].sum()) for r in known],
                   "tail_words": [int((c == tail).sum()) for c in wide.classes], "forward": own}

    spec = ("row:long, doc_id:long, held_out:boolean, n_tokens:long, near_known:long, logs:double, tail_logs:double, "
            "tail_words:long, forward:double")
    scored = map_batches(with_wide(documents.select("row", "doc_id", "held_out", "ranks", "far"), links, emissions, config), spec, score)
    # Words beyond the head: each word of a document once, with its number there.
    far = documents.select("row", F.explode("far").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    logs = F.col("times") * F.log10(F.col("seen") + 1)
    found = far.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("far_known"), F.sum(logs).alias("far_logs"),
        F.sum(F.when(F.col("seen") < config.least_seen, logs)).alias("far_tail_logs"))
    joined = scored.join(found, "row", "left").withColumns({
        "far_known": F.coalesce("far_known", F.lit(0)), "far_logs": F.coalesce("far_logs", F.lit(0.0)),
        "far_tail_logs": F.coalesce("far_tail_logs", F.lit(0.0))})
    base = F.col("logs") + F.col("far_logs") - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))
    full = (F.col("forward") + F.col("tail_logs") + F.col("far_tail_logs")
            - F.col("tail_words") * F.lit(float(np.log10(vocabulary.tail_weight))))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("near_known") + F.col("far_known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))
