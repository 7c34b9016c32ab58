"""Token ids of whole texts from the tokenizers library, remembered by word.

The library encodes about 1 MB a second, most of it spent on words met before. A text is therefore cut where the
vocabulary's pre-tokeniser always cuts, each distinct word is encoded once per worker by the library (its full pipeline,
or its model alone where a word is plain Latin), and the ids of a text are put together from those of its words. Texts in
which a cut could matter (special strings, unusual white space) go to the library whole. The ids equal the library's for
the whole text; tests compare both.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np

from embertrace.llm.common import worker_memory
from embertrace.llm.token_counts import byte_symbols

MEMO_WORDS = 700_000
MEMO_PIECES = 300_000
#: ASCII, and the composed Latin-1 letters, which no normaliser here changes but for their case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: Letters and at most one mark or digit after them: most new words are of this kind.
_LETTERS_MARK = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-@\\[-`{-~]?)").fullmatch
#: Pieces of plain words under the two vocabularies' split patterns.
_WORD_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
_BYTE_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[^A-Za-z0-9À-ÖØ-öø-ÿ]+").findall
_ODD_SPACE = re.compile(r" (?=\s|\Z)").search


class _Memo(dict):
    """Words to numbers; the ids of word n are ``ids[ends[n]:ends[n + 1]]``. A new word is spelled as it is looked up."""

    def __init__(self, spell_new: Callable[[str], Sequence[int]]) -> None:
        super().__init__()
        self.spell_new = spell_new
        self.ends, self.ids = array("q", [0]), array("I")

    def __missing__(self, word: str) -> int:
        # Spelling may add the word's own parts, so the number is taken afterwards.
        self.ids.extend(self.spell_new(word))
        self.ends.append(len(self.ids))
        number = self[word] = len(self)
        return number

    def of(self, word: str) -> array:
        number = self[word]
        return self.ids[self.ends[number]: self.ends[number + 1]]

    def spell(self, words: list[str]) -> np.ndarray:
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        # These views are gone before the arrays grow again.
        bounds = np.frombuffer(self.ends, np.int64)
        starts = bounds[numbers]
        lengths = bounds[numbers + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.empty(0, np.uint32)
        return np.frombuffer(self.ids, np.uint32)[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class TextEncoder:
    """``encode(text)`` gives the library's ids of a text as unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        # With word ends, white space is dropped; else a space belongs to the word after it.
        self.by_words = bool(spec["model"]["end_of_word_suffix"])
        self.space = "" if self.by_words else " "
        self.model = self.library.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.lead = self.space.translate(self.symbols)
        self.pieces: dict[str, list[int]] = {}
        self.memo = _Memo(self._new)

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _model(self, piece: str, lead: str) -> list[int]:
        """Ids of one piece, after ``lead`` (in byte symbols)."""
        if not piece.isascii() or piece == "\n":
            piece = piece.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.model.tokenize(lead + piece)]

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = self._model(piece, "")
        return found

    def _new(self, word: str) -> Sequence[int]:
        """Ids of a word with the space before it, if the vocabulary keeps spaces."""
        if word.isascii() and word.isalpha() and not (self.by_words and not word.islower()):
            return [t.id for t in self.model.tokenize(self.lead + word)]
        simple = _LETTERS_MARK(word)
        if simple is None:
            return self._word(word, self.space)
        letters, mark = simple.groups()
        if self.by_words:
            letters = letters.lower()
        if letters == word:
            return self._model(word, self.lead)
        ids = self.memo.of(letters)
        return ids + array("I", self._piece(mark)) if mark else ids

    def _word(self, word: str, space: str) -> Sequence[int]:
        if not _PLAIN(word):
            lines = word.split("\n")
            if len(lines) == 1 or not all(map(_PLAIN, lines)):
                return self._whole(space + word)
            # A line break between two words is a piece of its own.
            ids = list(self.memo.of(lines[0]) if space else self._word(lines[0], space))
            for line in lines[1:]:
                ids += self._piece("\n")
                ids += self._word(line, "")
            return ids
        if self.by_words:
            pieces = _WORD_PIECES(word.lower())
            # A piece is a word of its own with the same ids.
            return self._model(word, "") if pieces == [word] else [i for p in pieces for i in self.memo.of(p)]
        # A space joins the run after it, so a contraction's quote at the start is a symbol run of its own.
        if space and word[0] == "'":
            return self._whole(space + word)
        pieces = _BYTE_PIECES(word)
        if len(pieces) == 1:
            return self._model(word, self.lead) if space else self._piece(word)
        head = self.memo.of(pieces[0]) if space else self._piece(pieces[0])
        return [*head, *(i for p in pieces[1:] for i in self._piece(p))]

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self._whole(text), np.uint32)
        if self.by_words:
            # The normaliser lower-cases; in ASCII that is done before words are told apart, so fewer are new.
            words = (text.lower() if text.isascii() else text).split()
        elif _ODD_SPACE(text):
            return np.array(self._whole(text), np.uint32)
        else:
            words = text.split(" ")
        head = np.empty(0, np.uint32)
        if self.space:
            first, words = words[0], words[1:]
            head = np.array(self._word(first, "") if first else [], np.uint32)
        ids = self.memo.spell(words)
        if len(self.memo) > MEMO_WORDS:
            self.memo = _Memo(self._new)
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        return np.concatenate([head, ids]) if len(head) else ids


def encoder(vocabulary: str) -> TextEncoder:
    """The worker's encoder of a vocabulary file; it outlives tasks."""
    return worker_memory(f"encode {vocabulary}", lambda: TextEncoder(vocabulary))
