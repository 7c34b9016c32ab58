"""Token counts by byte-pair merging with a heap and a linked list, without producing identifiers.

A piece of text starts as a chain of symbols (its bytes; the last one marked as a word end where the vocabulary does so).
The adjacent pair of lowest merge rank is popped from a heap and merged in the chain until none is left. Every merge
shortens the chain by one, so the count is symbols minus merges. The merge table is reduced to integers: a symbol is the
number of its text, a pair maps to (rank, merged symbol).

The vocabulary file supplies its own normaliser, pre-tokeniser and special strings. ASCII words take a shorter way with
the same outcome; all other words, control characters included, are normalised and split by the library itself. A text
is cut at ASCII white space first, which no piece of these pre-tokenisers spans, so the count of a text is the sum over its
words and a word's count is remembered in each worker (the memory is emptied when it reaches ``MEMO`` words; that
changes no count).

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as one token each;
repeated rows count each; an empty table gives an empty result; only the named columns are read. Texts are never cut
short. One pass over the texts, no shuffle.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from embertrace.llm.common import map_batches, sheltered, text_bytes, worker_memory

MEMO = 1_000_000
_PLAIN = re.compile(rb"[!-~]+").fullmatch
#: The contractions, letter runs, single digits and symbol runs of the word vocabulary's split pattern.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable bytes as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of pieces with a merge list."""

    def __init__(self, merges: list, word_end: str) -> None:
        self.number: dict[str, int] = {}
        self.word_end = word_end
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = self._symbol(left), self._symbol(right)
            self.merge.setdefault(key, (rank, self._symbol(left + right)))

    def _symbol(self, text: str) -> int:
        return self.number.setdefault(text, len(self.number))

    def count(self, piece: str) -> int:
        """Tokens of one piece, written in byte symbols."""
        if not piece:
            return 0
        texts = list(piece)
        texts[-1] += self.word_end
        symbol = [self._symbol(t) for t in texts]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = []
        for i in range(n - 1):
            found = merge.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            # Skip pairs of which a half has been merged meanwhile (a dead symbol is -1).
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merge.get((made, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merge.get((symbol[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
            merges += 1
        return n - merges


class WordCounter:
    """Counts the tokens of words under a vocabulary file of the tokenizers library."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary)
        spec = json.loads(library.to_str())
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = set(special)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else lambda word: [word]
        self.counter = MergeCounter(spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or "")
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}

    def _piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = self.counter.count(piece)
        return found

    def _word(self, word: bytes) -> int:
        if _PLAIN(word) and b"<|" not in word:
            return sum(map(self._piece, _PIECES(word.decode("ascii").lower())))
        parts = self.cut(word.decode("utf-8", "replace"))
        return sum(
            1 if part in self.special else sum(self._piece(p) for p, _ in self.split(self.normalise(part)))
            for part in parts if part)

    def count(self, text: bytes) -> int:
        words = text.split()
        known = self.words
        for word in set(words).difference(known):
            known[word] = self._word(word)
        total = sum(map(known.__getitem__, words))
        if len(known) + len(self.pieces) > MEMO:
            known.clear()
            self.pieces.clear()
        return total


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``id_column, n_bytes, n_tokens, over_limit`` of every row.

    ``vocabulary`` is a file of the tokenizers library whose pre-tokeniser drops white space and lower-cases words.
    """

    def run(batches):
        counter = worker_memory(f"count {vocabulary}", lambda: WordCounter(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield {"id": batch.column(0), "n_bytes": [len(t) for t in texts], "n_tokens": [counter.count(t) for t in texts]}

    rows = sheltered(docs, (id_column, text)).select(F.col(id_column).cast("long").alias("id"), text_bytes(text).alias("text"))
    counted = map_batches(rows, "id:long, n_bytes:long, n_tokens:long", run)
    over: Column = F.col("n_tokens") > limit
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", over.alias("over_limit"))
