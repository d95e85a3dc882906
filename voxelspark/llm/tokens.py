"""Token ids of whole texts by a public tokenizer file, with words looked up before they are encoded."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

#: Marks that the tokenizer's split pattern parts from a letter before them.
MARKS = b".,;:!?*#$%&|"


class Table(dict):
    """What ``make`` gives for a key, kept until ``keep`` keys are there; then the table starts anew."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep = make, keep

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.keep:
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Encodes texts with a ``tokenizers`` file whose split drops white space, so ids of white-space words just follow each other.

    ids of a word are kept as little-endian unsigned 32-bit bytes. A word of letters, maybe with marks behind, is one or two
    pieces of the split and goes straight to the model; any other word goes through the whole tokenizer. Special tokens count as
    in the plain call with ``add_special_tokens=False``.
    """

    def __init__(self, path: str, keep: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = lambda text: alphabet.pre_tokenize_str(text)[0][0]
        self.words, self.stems = Table(self._word, keep), Table(self._stem, keep * 2 // 3)

    def _plain(self, text: str) -> bytes:
        return np.array(self.full.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _stem(self, text: str) -> bytes:
        """Lower-case letters, composed."""
        return np.array([t.id for t in self.model.tokenize(text if text.isascii() else self.spelled(text))], "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        base = word.rstrip(MARKS)
        text = base.decode()
        if text.isalpha():
            low = text.lower()
            if base.isascii() or (low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)):
                own = self.stems[low]
                return own + self._tail(word[len(base) :]) if len(word) > len(base) else own
        return self._plain(word.decode())

    def _tail(self, marks: bytes) -> bytes:
        key = marks.decode()
        if key not in self.stems:
            self.stems[key] = self._plain(key)
        return self.stems[key]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of each UTF-8 text, as bytes."""
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, which keeps its tables from task to task."""
    return WordTokenizer(path)
