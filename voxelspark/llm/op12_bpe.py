"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a piece ends in one token, and what stands before that token is the encoding of a shorter
prefix. So it is enough to store each prefix's last token: of the tokens that are suffixes of the prefix, it is the one that can
stand behind the last token of what it leaves. An automaton over the vocabulary (suffix links from each state to the next shorter
suffix that is a token) gives the candidates symbol by symbol, a test of two neighbours settles which of them it is, and going
back from the whole piece gives its ids. No pair is ever merged, and the work is linear in the piece's length.

Two tokens can stand side by side if no merge across their border would have come before the merges that made them. The test
undoes the newer of the two tokens nearest to the border until single symbols are left.

A text is normalised and split as the tokenizer file says; the last symbol of a piece carries the file's end-of-word mark, and is
a symbol of its own here. Special tokens are found in the raw text. Where the split drops white space, words between white space are
encoded on their own and looked up in a bounded table; a text is read in slices, so what a task holds is one batch and one text's
ids. Nothing is shuffled.

Edge cases: null or empty text has no ids and decodes to the empty text; a text of any length, white space alone, one endless word
and special tokens inside words are encoded as the library does; equal texts give equal ids, repeated rows are encoded each; no two
candidates tie (the last token is unique); a null id is kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import R
from voxelspark.llm.op9_packing import default_tokenizer
from voxelspark.plans.iterate import bounded_batches

ENCODED = "doc_id long, n_tokens long, ids array<int>"
#: Added to the code of a piece's last symbol where the file marks word ends.
LAST = 0x10000
NEVER = 1 << 62
#: Pieces encoded at once: some 20 candidates each are held.
PIECES = 1 << 13
SPACE = re.compile(rb"[\x09-\x0D\x20]")
#: Bytes that byte-level vocabularies write as the character of the same number; the others follow from 256 on in order.
AS_IS = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
#: Marks that the split below parts from a letter before them.
MARKS = b".,;:!?*#$%&|"
#: The normaliser and split (fixed values) under which a word of letters, maybe with marks behind, is known to be one or two pieces.
WORDS = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Words of Latin letters as they stand composed (so lower case is letter by letter), maybe with marks behind.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
LATIN = LETTERS + r"[.,;:!?*#$%&|]*$"


def alphabet() -> dict[int, int]:
    """Code of a byte-level vocabulary's character to the byte's own."""
    return {b: b for b in AS_IS} | {256 + k: b for k, b in enumerate(b for b in range(256) if b not in AS_IS)}


class Recent(dict):
    """What ``make`` gives for a key; the ``keep`` or more keys asked for last stay, at most twice as many."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.older = make, keep, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Merges:
    """Vocabulary and merges of a BPE model: tokens as runs of symbols, and which tokens can be neighbours."""

    def __init__(self, model: dict, keep: int = 100_000):
        if model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-pair models are known")
        suffix, vocab, byte = model.get("end_of_word_suffix") or "", model["vocab"], alphabet()
        self.last = LAST if suffix else 0
        n = max(vocab.values(), default=-1) + 1
        self.spelled, self.length = {}, [0] * n
        for token, k in vocab.items():
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            codes = [byte.get(ord(c), ord(c)) for c in (token[: -len(suffix)] if ends else token)]
            codes[-1] += LAST * ends
            self.spelled[k], self.length[k] = "".join(map(chr, codes)), len(codes)
        self.rank, self.left, self.right, self.merged = [-1] * n, [-1] * n, [-1] * n, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.rank[whole] >= 0 or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError(f"merge {rank} makes a token that has been made, or uses one that has not")
            self.rank[whole], self.left[whole], self.right[whole], self.merged[a, b] = rank, a, b, rank
        self.pairs = Recent(lambda key: self._neighbours((key >> 32, key & 0xFFFFFFFF)), keep)
        self.single: dict[str, int] = {}
        self.tokens = self._automaton()
        self.lengths = np.array(self.length, np.int64)
        self.single_of = np.full(2 * 256, -1, np.int64)
        for c, k in self.single.items():
            if ord(c) % LAST < 256:
                self.single_of[ord(c) % LAST + 256 * (ord(c) >= LAST)] = k

    def _neighbours(self, pair: tuple[int, int], ends: int = NEVER) -> bool:
        """Whether the encoding of both tokens' symbols is just these two, as long as merges of rank ``ends`` and later are left out."""
        a, b = pair
        a_ends = b_ends = ends  # the rank at which what is nearest to the border is merged away from it
        while True:
            across = self.merged.get((a, b), NEVER)
            if across < a_ends and across <= b_ends and across < ends:  # of equal merges the left one comes first
                return False
            if self.rank[a] > self.rank[b]:
                a_ends, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                b_ends, b = self.rank[b], self.left[b]
            else:
                return True

    def _automaton(self):
        """Of the tokens that their own symbols encode to (no other can be in any encoding), but for single symbols, each of which
        is the candidate that is left where no longer one fits."""
        import ahocorasick

        own, found = [False] * len(self.length), ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k in sorted(self.spelled, key=lambda k: self.rank[k]):
            a, b = self.left[k], self.right[k]
            own[k] = self.length[k] == 1 if a < 0 else own[a] and own[b] and self._neighbours((a, b), self.rank[k])
            if own[k] and a < 0:
                self.single[self.spelled[k]] = k
            elif own[k]:
                found.add_word(self.spelled[k], k)
        found.make_automaton()
        return found

    def last_tokens(self, symbols: str) -> list[int] | array:
        """The last token of every prefix, -1 where a prefix ends in a symbol of no token."""
        last = [self.single.get(c, -1) for c in symbols]
        if len(last) >= 4096:
            last = array("i", last)
        length, pairs, done = self.length, self.pairs, -1
        for end, token in self.tokens.iter(symbols):
            if end != done:
                before = end - length[token]
                if before < 0 or pairs[last[before] << 32 | token]:
                    last[end], done = token, end
        return last

    def encode(self, piece: bytes) -> bytes:
        """ids of a piece, little-endian."""
        text = piece.decode("latin-1")
        last = self.last_tokens(text[:-1] + chr(piece[-1] + self.last))
        if -1 in last:
            raise ValueError(f"no token for a symbol of {piece[:40]!r}")
        at, ids, length = len(last) - 1, [], self.length
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        return pack(f"<{len(ids)}i", *reversed(ids))


class Remembered:
    """Answers for 64-bit keys, looked up many at once: a key's place is one of 2**``bits``, and the last key that came there stays."""

    def __init__(self, make, bits: int = 18):
        self.make, self.shift = make, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = (keys.astype(np.uint64) * np.uint64(R)) >> self.shift
        out, new = self.values[place], np.flatnonzero(self.keys[place] != keys)
        if len(new):
            own, at = np.unique(keys[new], return_inverse=True)
            told = np.array([self.make(k) for k in own.tolist()], bool)
            out[new] = told[at]
            self.keys[place[new]], self.values[place[new]] = keys[new], out[new]
        return out


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each length, one after the other."""
    edge = np.cumsum(length)
    return np.arange(edge[-1] if len(edge) else 0) + np.repeat(start - (edge - length), length)


def encode_pieces(merges: Merges, pairs: Remembered, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, number of ids of each piece) of many short pieces, none empty: place by place in all of them at once.

    The last symbol of a piece is none that a token has elsewhere, so no token is found across two pieces.
    """
    edge = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    codes = np.frombuffer(pieces.buffers()[2], np.uint8)[edge[0] : edge[-1]].astype("<u4")
    edge -= edge[0]
    start, size = edge[:-1], np.diff(edge)
    single = codes.astype(np.int64)
    single[edge[1:] - 1] += 256 * bool(merges.last)
    codes[edge[1:] - 1] += merges.last
    last, lengths = merges.single_of[single], merges.lengths
    found = list(merges.tokens.iter(codes.tobytes().decode("utf-32-le")))
    end, token = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else np.zeros((2, 0), np.int64)
    before, place = end - lengths[token], end - np.repeat(start, size)[end]
    whole = before < np.repeat(start, size)[end]
    by_place = np.argsort(place.astype(np.int16), kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(size.max(initial=0) + 1))
    for low, high in zip(cuts, [*cuts[1:], len(by_place)], strict=True):
        c = by_place[low:high]
        known = c[whole[c]]
        last[end[known]] = token[known]
        c = c[~whole[c]]
        c = c[pairs(last[before[c]] << 32 | token[c])]
        last[end[c]] = token[c]
    if (last < 0).any():
        raise ValueError("no token for a symbol of a piece")
    at, open_, back = edge[1:] - 1, np.arange(len(start)), []
    number = np.zeros(len(start), np.int64)
    while len(open_):
        t = last[at]
        back.append((open_, t))
        number[open_] += 1
        at = at - lengths[t]
        more = at >= start[open_]
        at, open_ = at[more], open_[more]
    after, ids = np.cumsum(number), np.zeros(int(number.sum()), np.int32)
    for k, (of, t) in enumerate(back):
        ids[after[of] - 1 - k] = t
    return ids, number


class PrefixTokenizer:
    """Whole texts to ids and back, by the rules of a ``tokenizers`` file with a BPE model."""

    def __init__(self, path: str, keep: int = 100_000, longest: int = 64, slice_bytes: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        tool = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.decoder = tool.normalizer, tool.pre_tokenizer, tool.decoder
        self.merges, self.longest, self.slice_bytes = Merges(told["model"]), longest, slice_bytes
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("only added tokens that stand as they are are known")
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.names = [""] * (max(chain(told["model"]["vocab"].values(), self.special.values())) + 1)
        for name, k in chain(told["model"]["vocab"].items(), self.special.items()):
            self.names[k] = name
        self.arrow_names = pa.array(self.names, pa.string())
        if '"ByteLevel"' not in json.dumps(told["pre_tokenizer"]):
            raise ValueError("only byte-level vocabularies are known")
        self.to_byte = alphabet()
        self.apart = self._pieces("a b") == [*self._pieces("a"), *self._pieces("b")]
        split = json.dumps(told["pre_tokenizer"])
        self.lettered = ([n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])], WORDS[1]) == WORDS and json.dumps(WORDS[1]) in split
        self.pairs = Remembered(self.merges.pairs.__getitem__)
        self.words, self.known = Recent(self._word, keep), Recent(self.merges.encode, keep * 2 // 3)

    def _pieces(self, text: str) -> list[bytes]:
        plain = self.normalizer.normalize_str(text) if self.normalizer else text
        return [p.translate(self.to_byte).encode("latin-1") for p, _ in self.splitter.pre_tokenize_str(plain)]

    def _any(self, text: str) -> bytes:
        out = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                out.append(pack("<i", self.special[part]))
            elif part:
                out += [self.known[p] if len(p) <= self.longest else self.merges.encode(p) for p in self._pieces(part)]
        return b"".join(out)

    def _word(self, word: bytes) -> bytes:
        """A word of letters, maybe with marks behind, is its lower case and the marks; anything else goes through the file's own rules."""
        base = word.rstrip(MARKS)
        text = base.decode()
        if self.lettered and text.isalpha() and len(base) <= self.longest:
            low = text.lower()
            if base.isascii() or (low.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)):
                return self.known[low.encode()] + (self.known[word[len(base) :]] if len(base) < len(word) <= self.longest else self._any(word[len(base) :].decode()))
        return self._any(word.decode())

    def _slices(self, text: bytes):
        at = 0
        while at < len(text):
            end = SPACE.search(text, at + self.slice_bytes)
            stop = end.end() if end else len(text)
            yield text[at:stop]
            at = stop

    def encode(self, text: bytes) -> bytes:
        """ids of a UTF-8 text, little-endian and signed."""
        if not self.apart:
            return self._any(text.decode())
        known, longest, word = self.words.__getitem__, self.longest, self._word
        return b"".join(known(w) if len(w) <= longest else word(w) for s in self._slices(text) for w in s.split())

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each word, number of ids of each word) of different words."""
        plain = pc.and_(pc.match_substring_regex(words, LATIN), pc.less_equal(pc.binary_length(words), self.longest)).to_numpy(zero_copy_only=False)
        first, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        other, mine = np.flatnonzero(~plain), np.flatnonzero(plain)
        known, word, longest = self.words.__getitem__, self._word, self.longest
        slow = [known(w) if len(w) <= longest else word(w) for w in words.take(pa.array(other)).cast(pa.binary()).to_pylist()]
        number[other] = np.fromiter(map(len, slow), np.int64, len(slow)) // 4
        parts = [np.frombuffer(b"".join(slow), "<i4")]
        first[other] = np.cumsum(number[other]) - number[other]
        if len(mine):
            own = words.take(pa.array(mine))
            stem = pc.utf8_lower(pc.utf8_rtrim(own, MARKS.decode())).dictionary_encode()
            mark = pc.replace_substring_regex(own, LETTERS, "").dictionary_encode()
            bounded = [encode_pieces(self.merges, self.pairs, stem.dictionary.slice(k, PIECES)) for k in range(0, len(stem.dictionary), PIECES)]
            s_ids, s_number = (np.concatenate(x) for x in zip(*bounded, strict=True))
            marks = [self._any(m) for m in mark.dictionary.to_pylist()]
            m_ids, m_number = np.frombuffer(b"".join(marks), "<i4"), np.fromiter(map(len, marks), np.int64, len(marks)) // 4
            s_at, m_at = stem.indices.to_numpy(), mark.indices.to_numpy()
            s_n, m_n = s_number[s_at], m_number[m_at]
            number[mine] = s_n + m_n
            after = np.cumsum(s_n + m_n)
            ids = np.zeros(int(after[-1]), np.int32)
            ids[runs(after - s_n - m_n, s_n)] = s_ids[runs((np.cumsum(s_number) - s_number)[s_at], s_n)]
            ids[runs(after - m_n, m_n)] = m_ids[runs((np.cumsum(m_number) - m_number)[m_at], m_n)]
            first[mine] = len(parts[0]) + after - s_n - m_n
            parts.append(ids)
        return np.concatenate(parts), first, number

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each text): words that texts share are encoded once."""
        if not (self.apart and self.lettered):
            got = [self.encode(t.encode()) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(got), "<i4"), np.fromiter(map(len, got), np.int64, len(got)) // 4
        split = pc.ascii_split_whitespace(texts)
        word = split.flatten().dictionary_encode()
        ids, first, number = self._distinct(word.dictionary)
        at = word.indices.to_numpy()
        of = np.zeros(len(at) + 1, np.int64)
        np.cumsum(number[at], out=of[1:])
        return ids[runs(first[at], number[at])], np.diff(of[split.offsets.to_numpy() - split.offsets[0].as_py()])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids: tokens joined by a space where the file names no decoder, else by its decoder."""
        if self.decoder is not None:
            return pa.array([self.decoder.decode([self.names[k] for k in row]) for row in ids.to_pylist()], pa.string())
        named = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), self.arrow_names.take(ids.flatten()))
        return pc.binary_join(named, " ")


@lru_cache(maxsize=1)
def prefix_tokenizer(path: str) -> PrefixTokenizer:
    """One per Python worker, which keeps its tables from task to task."""
    return PrefixTokenizer(path)


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text; texts are read about ``batch_bytes`` at a time, a longer one on its own in slices."""

    bounded_batches(docs.sparkSession)

    def run(batches):
        tool = prefix_tokenizer(tokenizer)
        for b in batches:
            body = b.column(1)
            edge = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
            at = 0
            while at < len(body):
                stop = min(len(body), max(at + 1, int(np.searchsorted(edge, edge[at] + batch_bytes, "right")) - 1))
                if edge[stop] - edge[at] > batch_bytes:
                    ids = np.frombuffer(tool.encode(body[at].as_py().encode()), "<i4")
                    number = np.array([len(ids)])
                else:
                    ids, number = tool.encode_many(body.slice(at, stop - at))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, stop - at), pa.array(number, pa.int64()), lists], ["doc_id", "n_tokens", "ids"])
                at = stop

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).mapInArrow(run, ENCODED)


def decode_ids(encoded: DataFrame, tokenizer: str, batch_ids: int = 1 << 20) -> DataFrame:
    """The rows of ``encode_texts`` with ``decoded``, the text of their ids, special tokens included."""

    def run(batches):
        tool = prefix_tokenizer(tokenizer)
        for b in batches:
            edge = b.column("ids").offsets.to_numpy()
            at = 0
            while at < b.num_rows:
                stop = min(b.num_rows, max(at + 1, int(np.searchsorted(edge, edge[at] + batch_ids, "right")) - 1))
                part = b.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns, tool.decode(part.column("ids"))], [*part.schema.names, "decoded"])
                at = stop

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{ENCODED}, decoded string")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    path = default_tokenizer()
    both = decode_ids(encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
