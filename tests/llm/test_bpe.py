"""Encoding by prefixes and decoding against the tokenizers library, and its tests of neighbours against plain merging."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelspark.llm import op12_bpe as T12

PATH = T12.default_tokenizer()
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tool():
    return T12.PrefixTokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    kinds = ["ab ", "aAn1' ", "inthere ", "abcdefghijklmnopqrstuvwxyz .,", "éàßΣσİ́日本ÀÇÿªµ×÷   'st.!?😂😍", " <|endoftext|>a", "😂😍", "=-_# ", "!?., a"]
    out = ["".join(rng.choice(kind) for _ in range(rng.randint(0, 60))) for _ in range(400) for kind in kinds]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(12)) for _ in range(500)]
    return [*out, "", " \n\t ", "<|startoftext|><|endoftext|>x<|endoftext|", "\x1c a\x85b c", "don't we'll", "a" * 200 + ".", "Z" * 64 + "!" * 70]


def test_texts_at_once_and_alone(tool, library):
    all_ = texts()
    ids, number = tool.encode_many(pa.array(all_))
    ends = np.cumsum(number)
    decoded = tool.decode(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids, pa.int32()))).to_pylist()
    for t, low, high, back in zip(all_, ends - number, ends, decoded, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[low:high].tolist() == want and np.frombuffer(tool.encode(t.encode()), "<i4").tolist() == want, t
        assert back == library.decode(want, skip_special_tokens=False)


def merged(merges, ids):
    """Plain byte-pair merging: the pair of lowest rank, the leftmost of equals, over and over."""
    ids = list(ids)
    while True:
        ranks = [(merges.merged[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merges.merged]
        if not ranks:
            return ids
        rank, k = min(ranks)
        ids[k : k + 2] = [merges.rank.index(rank)]


def test_neighbours(tool):
    m, rng = tool.merges, random.Random(3)
    short = [k for k in m.spelled if m.length[k] <= 4 and m.rank[k] < 3000]
    base = lambda k: [m.single[c] for c in m.spelled[k]]
    for _ in range(400):
        a, b = rng.choice(short), rng.choice(short)
        if ord(m.spelled[a][-1]) < T12.LAST:
            assert m._neighbours((a, b)) == (merged(m, base(a) + base(b)) == [a, b])


def test_last_token_of_every_prefix(tool, library):
    m = tool.merges
    word = "internationalisation"
    last = m.last_tokens(word)
    for k in range(1, len(word) + 1):
        assert merged(m, [m.single[c] for c in word[:k]])[-1] == last[k - 1]


def test_one_endless_word_and_slices(library):
    small = T12.PrefixTokenizer(PATH, slice_bytes=100)
    for t in ("ab" * 60_000 + "c", "one two " * 9000, "x" * 250 + " " + "é" * 150):
        assert np.frombuffer(small.encode(t.encode()), "<i4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_recent_stays():
    made = []
    table = T12.Recent(lambda k: made.append(k) or k, 3)
    for k in (1, 2, 3, 4, 1, 5, 6, 1):
        assert table[k] == k
    assert made == [1, 2, 3, 4, 5, 6] and len(table) + len(table.older) <= 6


def test_frames(spark, library):
    rows = [(k, t) for k, t in enumerate([None, "", " \n ", "Hello world's", "Hello world's", "tail " * 70_000, "x" * 70_000, "<|endoftext|> é"])] + [(None, "no id"), (3, "Hello world's")]
    clash = {c: F.lit("mine") for c in ("ids", "n_tokens", "decoded", "body")}
    for docs in (spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(rows, SCHEMA).withColumns(clash)):
        got = T12.decode_ids(T12.encode_texts(docs, PATH, batch_bytes=1 << 16), PATH, batch_ids=1000).collect()
        want = [(k, library.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
        assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got), key=repr) == sorted(((k, len(i), i, library.decode(i, skip_special_tokens=False)) for k, i in want), key=repr)
    assert T12.decode_ids(T12.encode_texts(spark.createDataFrame([], SCHEMA), PATH), PATH).isEmpty()


def test_query(spark, library):
    import __spark_entry__

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in __spark_entry__.queries()["op12_bpe"](spark, "/root/testdata/sf0.001").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    assert got == {k: (len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for k, i in ids.items()}


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        T12.Merges({"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"], ["a", "b"]]})
    with pytest.raises(ValueError):
        T12.Merges({"vocab": {}, "merges": [], "byte_fallback": True})
