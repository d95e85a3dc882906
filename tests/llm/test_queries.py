"""The registered queries, all their columns, against plain Python or DuckDB on the smallest tables."""

import hashlib
import math
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__
from voxelspark.llm import op6_semantic as T6
from voxelspark.llm.common import table
from voxelspark.llm.sql import SQL as TEXTS

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}


def rows(spark, name):
    return __spark_entry__.queries()[name](spark, DATA).collect()


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(TEXTS[name])
    columns = sorted(c[0] for c in cur.description)
    want = sorted((tuple(dict(zip([c[0] for c in cur.description], r, strict=True))[c] for c in columns) for r in cur.fetchall()), key=repr)
    got = __spark_entry__.queries()[name](spark, DATA)
    assert sorted(got.columns) == columns and sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want


def test_op1(spark, texts):
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tool, by_rank = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), {v: k for k, v in ranks.items()}
    got = {}
    for r in rows(spark, "op1_tokens"):
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids, edge = tool.encode_ordinary(t), [0]
        for i in ids:
            edge.append(edge[-1] + len(by_rank[i]))
        for s in got[k]:
            low, high = len(t[: s.start].encode()), len(t[: s.end].encode())
            share = sum((min(b, high) - max(a, low)) / (b - a) for a, b in zip(edge, edge[1:]) if min(b, high) > max(a, low))
            assert math.isclose(s.tokens, share, abs_tol=1e-6) and s.doc_tokens == len(ids) and s.end - s.start <= 2000
        assert [s.start for s in sorted(got[k], key=lambda s: s.section)] == list(range(0, max(1, len(t)), 2000))


def test_op2(spark, texts):
    got = rows(spark, "op2_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    same = {}
    assert all(same.setdefault(texts[r.doc_id], r.score) == r.score for r in got)
    toxic = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    known = [(r.predicted, toxic[r.doc_id]) for r in got if r.doc_id in toxic]
    assert sum(a == b for a, b in known) > 0.9 * len(known)


def test_op3(spark, texts):
    got = rows(spark, "op3_language")
    lang = {r.doc_id: r.lang for r in table(spark, DATA, "documents").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id])) for r in got)
    known = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(known) > 10 and np.mean(known) > 0.9


def test_op5(spark, texts):
    def fingerprint(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {k: fingerprint(t) for k, t in texts.items()}
    root = {k: k for k in prints}
    find = lambda k: k if root[k] == k else find(root[k])
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(map(tuple, rows(spark, "op5_simhash"))) == sorted((k, f"{p:016x}", find(k)) for k, p in prints.items())


def test_op6(spark):
    docs, benchmark = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    brute = T6.find_leaks(docs, benchmark, cosine=-2.0).selectExpr("row.doc_id", "explode(leaks) AS l").selectExpr("doc_id", "l.item_id", "l.lcs", "l.answer").collect()
    got = {(r.doc_id, r.item_id, round(r.lcs, 9), round(r.answer, 9)) for r in rows(spark, "op6_semantic")}
    assert got and got == {(r.doc_id, r.item_id, round(r.lcs, 9), round(r.answer, 9)) for r in brute}


def test_op7(spark, texts):
    got, same = rows(spark, "op7_transport"), {}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert same.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature) and r.media_bytes % 188 == 0
        packets, units, entries, _, breaks, errors = r.feature.split(":")
        assert int(packets) * 188 == r.media_bytes and int(units) == -(-len(payload) // 4096) and int(entries) == -(-int(units) // 8) and breaks == errors == "0"


def test_op9(spark, texts):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs, windows = {}, {}
    for r in rows(spark, "op9_packing"):
        docs.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert docs.keys() == texts.keys()
    for k, pieces in docs.items():
        ids = np.array([*tool.encode(texts[k], add_special_tokens=False).ids, 1], "<u4")
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and sum(r.length for r in pieces) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    for pieces in windows.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and sum(r.length for r in pieces) <= 2048
    assert sum(r.length for p in windows.values() for r in p) > 0.9 * 2048 * (len(windows) - 8)


def test_op10(spark, texts):
    got, shards = rows(spark, "op10_slots"), {}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts.items())
    for r in got:
        shards.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    load = [sum(r["size"] for r in s) for s in shards.values()]
    assert sorted(shards) == list(range(16)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    assert max(load) - min(load) < 2 * max(len(t) for t in texts.values())
