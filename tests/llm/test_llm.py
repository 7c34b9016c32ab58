"""Operators for training data against brute force, on the small tables and on awkward rows."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from embertrace.llm import html_text, jaccard, token_files
from embertrace.llm.hmm import HmmConfig, Lattice, hmm_scores, model_of
from embertrace.llm.jaccard import jaccard_components, one_of_each
from embertrace.llm.mixing import mix_sources
from embertrace.llm.packing import cut_lengths, pack
from embertrace.llm.quality import quality_rules, repeated_words
from embertrace.llm.repeats import cut, repeated_spans, without_repeats
from embertrace.llm.token_counts import WordCounter, count_tokens
from embertrace.llm.topk import top_k
from embertrace.llm.word_ids import TextEncoder

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept int, _part int, node string"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    shared = prose(99, 70)
    texts = [None, "", " \n\t ", "one two", "one two", "ONE two", prose(1, 120), prose(1, 120), prose(1, 119) + " end",
             prose(2, 60) + "\n" + shared + "\n" + prose(3, 30), shared.replace(" ", "  ") + " " + prose(4, 200), prose(5, 30_000),
             "x " * 400, "l'été ÀÉ <|endoftext|> it's 12 € \x1c\x85   end", "### $$ %% " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "a", 1, 2, "b") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[9], (None, prose(1, 120), None, None, None, None, None, None, None), (None,) * 9]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df) -> list[tuple]:
    return [(r.doc_id, (r.text or "")) for r in df.select("doc_id", "text").collect()]


# --- words and tokens ---------------------------------------------------------------------


def odd_texts() -> list[str]:
    import random

    rng = random.Random(7)
    letters = "abc XYZ 'é́ßİΣ \t\n\r  0123٣²'s're_-!#\x1c\x85中文🙂<|endoftext|>é A\x00àÀ×÷ÿÆ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    parts = ["it's", "'s", "foo's", "<|endoftext|>", "<|startoftext|>x", "É́", "\n\n", "", "a'LL", "l'été,", "ÀB×c", "aª", "12ab", "…"]
    return out + [" ".join(rng.choice(parts) for _ in range(12)) for _ in range(300)]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_ids_equal_the_library(documents, path):
    library, own = Tokenizer.from_file(path), TextEncoder(path)
    for text in odd_texts() + [t for _, t in texts_of(documents)]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_counts_equal_the_library(documents, awkward, nothing):
    library, own = Tokenizer.from_file(WORD_BPE), WordCounter(WORD_BPE)
    for text in odd_texts():
        assert own.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    for docs in (documents, awkward):
        want = sorted((i if i is not None else -1, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(docs))
        got = count_tokens(docs, WORD_BPE).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert count_tokens(nothing, WORD_BPE).count() == 0


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 40, 30_000), np.zeros(5000, int), np.arange(100), np.array([7]), np.tile(rng.integers(0, 9, 50), 300)):
        ids = ids.astype(np.uint32)
        base, rules, lengths, symbols = token_files.repair(ids)
        assert (token_files.expand(base, rules.astype(np.int64), lengths, symbols.astype(np.int64)) == ids).all()
        row = {"base": base, "rules": rules.tobytes(), "rule_lengths": lengths.tobytes(), "symbols": symbols.tobytes()}
        for start, stop in ((0, 1), (0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids))):
            assert (token_files.read_range(row, start, stop) == ids[start:stop]).all()
    assert len(token_files.repair(np.zeros(5000, np.uint32))[3]) < 100


def test_token_files(spark, documents, awkward, nothing, tmp_path):
    library = Tokenizer.from_file(WORD_BPE)
    for name, docs in (("a", documents), ("b", awkward), ("c", nothing)):
        path = str(tmp_path / name)
        token_files.write_token_files(docs, WORD_BPE, 2, path, shard_ids=3000)
        got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        at = 0
        for r in got:
            assert r.start == at and len(r.ids) == 4 * r.n_tokens
            at += r.n_tokens
        encoded = collections.Counter((i, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts_of(docs))
        assert encoded == collections.Counter((r.doc_id, bytes(r.ids)) for r in got)


def test_packing(documents, awkward, nothing):
    assert cut_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    library = Tokenizer.from_file(BYTE_BPE)
    for docs in (documents, awkward):
        rows = pack(docs, BYTE_BPE, 1).collect()
        fill: dict[int, list] = collections.defaultdict(list)
        for r in rows:
            fill[r.sequence_id].append((r.offset, r.length))
            assert len(r.ids) == 4 * r.length
        for places in fill.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048 and at & (at - 1) == 0
        assert sorted(fill) == list(range(len(fill)))
        want = collections.Counter()
        for i, t in texts_of(docs):
            ids, at = [*library.encode(t, add_special_tokens=False).ids, 1], 0
            for length in cut_lengths(len(ids), 2048):
                want[i, at, len(ids), np.array(ids[at: at + length], "<u4").tobytes()] += 1
                at += length
        assert want == collections.Counter((r.doc_id, r.start, r.doc_tokens, bytes(r.ids)) for r in rows)
    assert pack(nothing, BYTE_BPE, 1).count() == 0


# --- mixing and quality -------------------------------------------------------------------


def water_filled(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        for s in order:
            target[s] = 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_)
        more = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


def test_mixing(spark, documents, awkward, nothing):
    few = spark.createDataFrame([(1, "a " * 5, "x"), (2, "b " * 500, "y"), (3, "c " * 3000, "z"), (4, None, None)], "doc_id long, text string, source string")
    for docs in (documents, awkward, few):
        sources = {(r.doc_id, r.text): r.source for r in docs.select("doc_id", "text", "source").collect()}
        rows = mix_sources(docs).collect()
        again = mix_sources(docs).collect()
        size, taken, largest, target = (collections.Counter() for _ in range(4))
        per_row = collections.Counter()
        for r in rows:
            own = len(WORDS.findall((r.text or "").encode()))
            source = sources[r.doc_id, r.text]
            assert r.mix_size == own
            if r.mix_pass == 0:
                size[source] += own
            taken[source] += own * r.mix_taken
            per_row[r.mix_row] += r.mix_taken
            largest[source], target[source] = max(largest[source], own), r.mix_target
        assert len(per_row) == docs.count() and max(per_row.values()) <= 3
        want = water_filled(dict(size))
        for s in size:
            assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= largest[s]
        key = lambda r: (str(r.doc_id), r.text or "", r.mix_pass, r.mix_taken)
        assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mix_sources(nothing).count() == 0


def base_counts(text: str) -> tuple:
    words = WORDS.findall(text.encode())
    lines = [x for x in text.split("\n") if WORDS.search(x.encode())]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k: k + 3])] > 1 for j in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality(spark, sf_dir, documents, awkward, nothing):
    for docs in (documents, awkward):
        rows = quality_rules(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            counts = base_counts(r.text or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
            assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert r.kept is not None and not (r.base_failed and r.kept)
    assert quality_rules(nothing).count() == 0
    assert "_part" in quality_rules(awkward).columns
    assert repeated_words([b"a"] * 4) == 4 and repeated_words([b"a"] * 3) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules(documents).join(labels, "doc_id").filter("NOT base_failed")
    assert judged.filter("quality = 1 AND NOT kept").count() == 0
    assert judged.filter("quality = 0 AND kept").count() == 0


# --- near duplicates and repeats -----------------------------------------------------------


def brute_components(rows: list[tuple]) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
        sets.append({tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest: dict[int, list] = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        smallest[root(i)].append(doc)
    first = {r: min((d for d in ds if d is not None), default=None) for r, ds in smallest.items()}
    return [(doc, len(sets[i]), first[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def chain_rows() -> list[tuple]:
    """Near copies in a chain, copies of a passage in otherwise different texts, and a large group of near copies."""
    base = prose(11, 80).split()
    rows = []
    for k in range(12):  # each differs a little more from the first
        rows.append((100 + k, " ".join(prose(200 + k, 1) if 3 <= j < 3 + k else w for j, w in enumerate(base))))
    rows += [(200 + k, " ".join(base[:40]) + " " + prose(300 + k, 20)) for k in range(40)]
    near = prose(12, 60).split()
    for k in range(60):
        changed = list(near)
        changed[k] = f"new{k}"
        rows.append((300 + k, " ".join(changed)))
    return rows


def test_jaccard(spark, documents, awkward, nothing, monkeypatch):
    chain = spark.createDataFrame(chain_rows(), "doc_id long, text string")
    for docs in (documents, awkward, chain):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()]
        assert sorted(got, key=repr) == sorted(brute_components(texts_of(docs)), key=repr)
    assert jaccard_components(nothing).count() == 0
    expected = sorted(brute_components(texts_of(chain)), key=repr)
    for ranked, slots in ((0, jaccard.FILTER_SLOTS), (10, 4)):  # the order of tokens and the way to shared ones change no row
        monkeypatch.setattr(jaccard, "FILTER_SLOTS", slots)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(chain, ranked_tokens=ranked).collect()]
        assert sorted(got, key=repr) == expected
    once = one_of_each(awkward).collect()
    assert {r.doc_id for r in once} == {0, 1, 2, 3, 6, 9, 10, 11, 12, 13, 14, None}
    assert one_of_each(awkward).columns == awkward.columns


def test_jaccard_at_the_threshold(spark, monkeypatch):
    """Single documents with 30 shingles of 40 in common, and others with fewer, without groups from minimum hashes."""
    monkeypatch.setattr(jaccard, "MIN_HASHES", 0)
    rows = []
    for k in range(80):
        words = prose(5000 + k, 39).split()[:39]
        changed = list(words)
        changed[20] = f"other{k}"
        if k % 4 == 0:
            changed[38] = f"last{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def brute_repeats(rows: list[tuple], length: int) -> tuple[dict, dict]:
    seen = collections.defaultdict(list)
    for n, (_, text) in enumerate(rows):
        w = WORDS.findall(text.encode())
        for k in range(len(w) - length + 1):
            seen[tuple(w[k: k + length])].append((n, k))
    covered = collections.defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for n, k in places:
                covered[n].update(range(k, k + length))
    return covered, seen


def test_repeats(documents, awkward, nothing):
    for docs in (documents, awkward):
        rows = texts_of(docs)
        covered, _ = brute_repeats(rows, 50)
        want = {(rows[n][0], len(places)) for n, places in covered.items()}
        got = repeated_spans(docs).collect()
        spans = {(r.doc_id, r.repeated_words) for r in got}
        assert spans == want
        for r in got:
            assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.repeated_words
            assert all(any(a <= c and d <= b for a, b in zip(r.starts, r.ends)) for c, d in zip(r.copy_starts, r.copy_ends))
        assert sum(r.copied_words for r in got) < sum(r.repeated_words for r in got)
        # Nothing repeats across different rows once copies are cut; equal rows are equal still.
        after = list({(r.doc_id, r.text or "") for r in without_repeats(docs).collect()})
        before = {w for _, t in rows for w in WORDS.findall(t.encode())}
        assert before == {w for _, t in after for w in WORDS.findall(t.encode())}
    assert repeated_spans(nothing).count() == 0 and without_repeats(nothing).count() == 0
    assert without_repeats(awkward).columns == awkward.columns and without_repeats(awkward).count() == awkward.count()
    assert cut(b" a b  c\nd e", [1, 3], [3, 4]) == b" a e"


# --- search, pages, language model ------------------------------------------------------------


def test_topk(spark, sf_dir):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    vectors += [(300 + i, vectors[50][1]) for i in range(12)]  # ties
    vectors += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6),
                (450, [1.0, 2.0]), (451, [3.0, 4.0]), (500, [0.0] * 6)]
    small = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, query_id string").repartition(4)
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for frame in (small, given):
        rows = [(r.vec_id, r.embedding) for r in frame.select("vec_id", "embedding").collect()]
        good = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v in rows
                if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
        want = []
        for q, v in good.items():
            if q % 50 == 0:
                scores = sorted((-int(v @ x), i) for i, x in good.items() if i != q and len(x) == len(v))[:5]
                want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
        got = top_k(frame, F.col("vec_id") % 50 == 0, query_rows=3, block_rows=64).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(small.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_html(spark, sf_dir):
    article = "<nav><ul><li>menu</ul></nav><div class=ad>buy</div><article><h1>T &amp; U</h1><p>One\n two<br>three<p><b>Four</b>, five</article>"
    cases = [
        (1, "http://a.example/x", page(article + "<footer>&copy;</footer>"), "T & U\nOne two three\nFour, five"),
        (2, None, None, ""), (3, "", "", ""), (4, "http://b.example", "<p>broken <b>page", "broken page"),
        (5, "http://b.example", page("<main><form>f<input></form><p>body</p><section id='comments'><p>me too</p></section></main>"), "body"),
        (6, "nonsense", page("<article><header><h1>Head</h1></header><p>x<aside>y</aside></p>z</article><!-- c -->"), "Head\nx\nz"),
    ]
    # Twelve pages of one host share a line that no rule names; each has its own text, and the first is repeated.
    for k in range(12):
        cases.append((20 + k, f"https://h.example/{k}", page(f"<div><p>Welcome to our site</p><p>{prose(k, 20)}</p></div>"), prose(k, 20)))
    cases += [(40, cases[6][1], cases[6][2], cases[6][3])] * 2
    frame = spark.createDataFrame([c[:3] + ("e",) for c in cases], "page_id long, url string, html string, text string").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(frame).collect())
    assert got == sorted((c[0], c[3], len(c[3])) for c in cases)
    assert html_text.extract_text(frame.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html

    for r in html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = (re.sub(r"</?b>", "", x).replace("<br>", " ") for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


def test_simple_tree_matching():
    a, b = (html_text.parse(page(x)) for x in ("<p>a</p><div><p>b</p></div><p>c</p>", "<div><p>b</p></div><p>x</p><p>c</p>"))
    pairs = [(x.text, y.text) for x, y in html_text.align(a, b)]
    assert len(pairs) == 2 and ("b", "b") in pairs  # the table keeps the div and one paragraph after it


def test_forward_and_baum_welch():
    config = HmmConfig(states=3, smoothing=1.0, stay=2.0)
    rng = np.random.default_rng(2)
    start, move, emit = model = model_of(rng.random(3), rng.random((3, 3)) * 5, rng.random((5, 3)) * 20, config)
    texts = [rng.integers(0, 5, n).astype(np.int32) for n in (4, 1, 6)]
    lattice = Lattice(texts, 4)
    scores, _, _ = lattice.forward(model, keep=False)
    import itertools

    for at, own in enumerate(lattice.order):
        words = texts[own]
        total = sum(start[p[0]] * emit[words[0], p[0]] * np.prod([move[a, b] * emit[w, b] for a, b, w in zip(p, p[1:], words[1:])])
                    for p in itertools.product(range(3), repeat=len(words)))
        assert scores[at] == pytest.approx(np.log10(total))
    starts, moves, states = lattice.expected(model)
    assert starts.sum() == pytest.approx(3) and moves.sum() == pytest.approx(sum(map(len, texts)) - 3) and np.allclose(states.sum(axis=1), 1)


def test_hmm(documents, awkward, nothing):
    for docs in (documents, awkward):
        rows = texts_of(docs)
        tokens = [[*WORDS.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), t.encode())), b" end"] for _, t in rows]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
        count = collections.Counter(w for h, ws in zip(held, tokens) if not h for w in ws)
        total = sum(count.values())
        want = sorted((str(i), h, len(ws), sum(count[w] > 0 for w in ws), total,
                       round(sum(np.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws), 6))
                      for (i, _), h, ws in zip(rows, held, tokens))
        # A small head makes the join do most of the work.
        for config in (HmmConfig(), HmmConfig(state_words=40, head_words=100)):
            got = hmm_scores(docs, config).collect()
            assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
            assert all(r.score < 0 for r in got)
            if docs is documents and config == HmmConfig():
                out = [r for r in got if r.held_out]
                assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert hmm_scores(nothing).count() == 0


def test_hmm_learns_every_word_whatever_is_broadcast(documents):
    scores = [{(r.doc_id, r.n_tokens, r.n_known): r.score for r in hmm_scores(documents, c).collect()}
              for c in (HmmConfig(), HmmConfig(state_words=40))]
    assert scores[0].keys() == scores[1].keys()
    assert all(scores[1][d] == pytest.approx(scores[0][d], rel=1e-6) for d in scores[0])


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, documents, awkward, nothing, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and corpus_pipeline.ORACLE_SQL is None
    for name, docs in (("given", documents), ("awkward", awkward), ("nothing", nothing)):
        columns = docs.columns
        for number, (_, function) in enumerate(corpus_pipeline.STAGES):
            before = docs
            path = str(tmp_path / f"{name}-{number}")
            function(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if number < 4:
                assert docs.columns == columns
            if number == 1 and name == "given":
                want = brute_components(texts_of(before))
                assert {r.doc_id for r in docs.collect()} == {c if n else d for d, n, c in want}
        assert docs.count() > 0 or name == "nothing"
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


STORY = " ".join(f"word{i}" for i in range(60))


def read_page(body: str) -> str:
    return html_text.main_text(html_text.parse(page(body)), {})


def test_html_keeps_text_whose_names_only_look_like_boilerplate():
    for link in ('href="/hidden-valley"', 'title="the hidden cost"', 'href="view.php?id=related"', 'data-role="menu"', "data-x='class=ad'"):
        assert read_page(f"<article><p>See <a {link}>the valley</a> now</p></article>") == "See the valley now"
    for name in ("no-sidebar", "post comments-open", "elementor-widget-container", "comments", "widget"):
        assert read_page(f"<div class='{name}'><p>{STORY}</p></div>") == STORY
        assert read_page(f"<main class='{name}'><h1>Top</h1><p>{STORY}</p></main>") == f"Top\n{STORY}"
    parts = "".join(f"<div class='elementor-widget-container'><h2>Part {i}</h2><p>{STORY}</p></div>" for i in range(4))
    assert read_page(parts) == "\n".join(f"Part {i}\n{STORY}" for i in range(4))
    assert read_page(f"<form id='aspnetForm'><nav><a href='/'>Home</a></nav><div><p>{STORY}</p></div></form>") == STORY
    assert read_page(f"<aside hidden><p>{STORY}</p></aside><p>short</p>") == f"{STORY}\nshort"


def test_html_still_drops_boilerplate():
    for extra in ("<div class='ad'>Buy this now.</div>", "<ul class='related-links-x'><li><a href='/a'>One more</a></li></ul>",
                  "<div hidden>secret</div>", "<div role=navigation>Up</div>", "<div class=social-share>Share it</div>",
                  "<div STYLE='display: none'>secret</div>", "<nav>Menu</nav>", "<form>Your mail <input></form>"):
        assert read_page(f"<div><p>{STORY}</p>{extra}</div>") == STORY


def test_html_content_is_not_only_in_articles():
    teaser = "<article class=teaser><a href='/b'>Another story</a></article>"
    assert read_page(f"<main><h1>Top</h1><p>{STORY}</p>{teaser}</main>") == f"Top\n{STORY}"
    assert read_page(f"<div><h2>Top</h2><p>{STORY}</p></div>{teaser}{teaser}") == f"Top\n{STORY}"
    card = "<article><a href='/b'>Another story</a></article>"
    assert STORY in read_page(f"<div><p>{STORY}</p></div>{card}{card}")
    assert read_page(f"<div>Top menu</div><article><p>{STORY}</p></article><p>End</p>") == STORY


def test_html_wrapper_grows_by_what_the_skeleton_lacks(spark):
    rows = []
    for k in range(40):
        extra = f"<div class=box><p>Now open in {prose(900 + k, 2)}</p><div><p>Read our <i>terms</i> here</p></div></div>" if k % 3 else ""
        menu = "".join(f"<li><a href='/{j}'>{prose(k * 9 + j, 1)}</a></li>" for j in range(5))
        # The pages of middle length lack the box, so the skeleton does.
        story = prose(k, 50 if not k % 3 else 20 if k % 2 else 90)
        rows.append((k, f"https://grow.example/{k}", page(f"<ul>{menu}</ul><div><p>{story}</p>{extra}</div>"), story))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, story string").repartition(3)
    stories = {r[0]: r[3] for r in rows}
    for r in html_text.extract_text(frame).collect():
        lines = r.text.split("\n")
        assert lines[0] == stories[r.page_id]
        assert "Read our terms here" not in r.text and len(lines) == 1 + bool(r.page_id % 3)


def test_repair_counts_only_pairs_of_new_symbols(monkeypatch):
    """After the first round only pairs that hold a symbol of the last round are counted; the ids come back."""
    counted = []
    spots = token_files._spots
    monkeypatch.setattr(token_files, "_spots", lambda keys: counted.append(len(keys)) or spots(keys))
    ids = np.concatenate([np.random.default_rng(3).integers(100, 5000, 20_000), np.tile([1, 2, 3, 4, 5, 6, 7], 300)]).astype(np.uint32)
    base, rules, lengths, symbols = token_files.repair(ids)
    assert counted[0] == len(ids) - 1 and max(c for c in counted[1:]) < 3000
    assert np.array_equal(token_files.expand(base, rules.astype(np.int64), lengths.astype(np.int64), symbols.astype(np.int64)), ids)
