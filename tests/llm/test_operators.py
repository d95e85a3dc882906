"""Each text operator against a brute-force model, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelspark.llm import op1_tokens as T1
from voxelspark.llm import op2_toxicity as T2
from voxelspark.llm import op3_language as T3
from voxelspark.llm import op4_substrings as T4
from voxelspark.llm import op5_simhash as T5
from voxelspark.llm import op6_semantic as T6
from voxelspark.llm import op7_transport as T7
from voxelspark.llm import op8_warc as T8
from voxelspark.llm import op9_packing as T9
from voxelspark.llm import op10_slots as T10
from voxelspark.llm.tokens import WordTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k}" for k in range(400))


def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, long texts, marks and other scripts."""
    texts = [None, "", " \n\t ", "one", "One two  three", "a b c d", "A B C D", LONG, LONG, "x " + LONG + " y", "tail " * 60, "été à Zürich, ñandú.", "日本語 テスト", "<|endoftext|> end", "é" * 33, LONG.upper()]
    rows = [(k, t, "en" if k % 2 else None, None, None) for k, t in enumerate(texts)]
    return [*rows, rows[7], (None, "no id", "en", "s", 5), (None, LONG, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_token_counts_add_up(spark, odd, none):
    import public_tokenizers as public

    how = {"ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}
    tool, _ = T1.encoder(how["ranks"], how["pattern"])
    cut = odd.withColumn("sections", T1.pieces_of("text", 7))
    for rule in ("first", "last", "middle", "split"):
        got = T1.attribute_tokens(cut, **how, sections_col="sections", rule=rule).toPandas()
        total = got.groupby(got.doc_id.fillna(-1))[["tokens"]].sum().tokens.to_dict()
        for k, t, *_ in odd_rows():
            if k not in (None, 7):
                assert abs(total[k] - len(tool.encode_ordinary(t or ""))) < 1e-6, (rule, k)
    lines = T1.attribute_tokens(spark.createDataFrame([(1, "a bc\nd\n\nzz"), (2, None)], "doc_id long, text string"), **how).collect()
    assert [(r.start, r.end) for r in lines if r.doc_id == 1] == [(0, 5), (5, 7), (7, 8), (8, 10)] and [(r.start, r.end, r.tokens) for r in lines if r.doc_id == 2] == [(0, 0, 0.0)]
    assert T1.attribute_tokens(none, **how).isEmpty()
    with pytest.raises(ValueError):
        T1.attribute_tokens(none, **how, rule="none")


def test_tokens_against_each_token():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 5, 30)
    end = np.cumsum(size)
    start = end - size
    spans = np.sort(rng.integers(0, end[-1] + 1, (40, 2)), axis=1)
    for rule in ("first", "last", "middle", "split"):
        count, crossing = T1.tally(start, end, spans[:, 0], spans[:, 1], rule)
        for (a, b), c, x in zip(spans.tolist(), count, crossing, strict=True):
            over = [(min(b, e) - max(a, s), s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True) if min(b, e) > max(a, s)]
            spot = {"first": lambda s, e: s, "last": lambda s, e: e - 1, "middle": lambda s, e: s + (e - s - 1) // 2}
            want = sum(o / (e - s) for o, s, e in over) if rule == "split" else sum(a <= spot[rule](s, e) < b for s, e in zip(start.tolist(), end.tolist(), strict=True))
            assert abs(c - want) < 1e-9 and x == sum(s < a or e > b for _, s, e in over)


def test_toxicity(spark, docs, odd, none):
    toxic = ["you are a foul wretch and a foul fool", "what a wretch, foul and vile"]
    clean = ["the river runs by the old mill", "we walked to the market at noon"]
    rows = [(k, (toxic if k % 4 == 0 else clean)[k // 4 % 2] + f" number {k}") for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = d.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = T2.fit_toxicity(d, labels, F.col("doc_id") < 80)
    got = {r.doc_id: r.score for r in model.score(d).where("doc_id >= 80").collect()}
    assert all((s >= 0.3) == (k % 4 == 0) for k, s in got.items())
    clash = model.score(odd.withColumn("score", F.lit("mine")))
    assert clash.count() == len(odd_rows()) and clash.where("score is null or score < 0 or score > 1").isEmpty()
    assert model.score(none).isEmpty()
    for frame in (labels.where("toxic = 1"), labels.limit(0)):
        assert {r.score > 0.5 for r in T2.fit_toxicity(d, frame).score(d).collect()} == {not frame.isEmpty()}


def test_language(spark, docs, odd, none):
    model = T3.fit_language(docs, F.col("doc_id") % 4 != 2)
    got = model.predict(docs).where("doc_id % 4 = 2")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 20 and right > 0.95
    strange = {r.doc_id: r for r in model.predict(odd).where("doc_id is not null").collect()}
    assert all(strange[k].lang_pred == "und" and strange[k].score == 0 for k in (0, 1, 2)) and strange[4].lang_pred != "und"
    assert model.predict(none).isEmpty() and {r.lang_pred for r in T3.fit_language(none).predict(odd).collect()} == {"und"}
    for k in (2, 4, 7, 12):
        code = T3.codewords(k).astype(int)
        assert len({tuple(c) for c in code}) == k and all(len(set(c)) == 2 for c in code.T)


def brute_repeats(rows, window):
    first = {}
    for k, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if k is not None:
                first[key] = min(first.get(key, k), k)
    out = []
    for k, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if k is not None and first[tuple(w[p : p + window])] < k:
                gone[p : p + window] = [True] * window
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "block"), [(50, 25), (4, 2), (5, 3)])
def test_substrings(spark, odd, none, window, block):
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in T4.remove_repeats(odd, window=window, block=block).collect()), key=repr)
    assert got == brute_repeats(odd_rows(), window)
    assert T4.remove_repeats(none).isEmpty()
    with pytest.raises(ValueError):
        T4.remove_repeats(odd, window=window, block=window)


def test_substrings_of_random_words(spark):
    rng = np.random.default_rng(4)
    shared = [" ".join(rng.choice(list("abcdef"), 12)) for _ in range(3)]
    rows = [(k, " ".join([*rng.choice(list("abcdef"), 8), *([shared[k % 3]] if k % 2 else []), *rng.choice(list("abcdef"), 6)]), None, None, None) for k in range(60)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in T4.remove_repeats(d, window=7, block=4).collect()), key=repr)
    assert got == brute_repeats(rows, 7)


def slow_simhash(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, none, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(1000 + k, t) for k, t, *_ in odd_rows() if k is not None]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {k: slow_simhash(t) for k, t in rows}
    ids = sorted(prints)
    root = {k: k for k in ids}
    find = lambda k: k if root[k] == k else find(root[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in T5.simhash_groups(d).collect()}
    assert got == {(k, prints[k], find(k)) for k in ids}
    assert T5.simhash_groups(none).isEmpty() and T5.simhash_groups(odd).count() == len(odd_rows())


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 51, 40, dtype=np.uint64)) for _ in range(20))]))
    near = np.unique(near & np.uint64((1 << 51) - 1))
    near = near[np.argsort(T5.gray_rank(near))]
    got = {(int(i), int(j)) for a, b in T5.GrayIndex(near, np.zeros(len(near), np.int64)).pairs(4) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(len(near)) for j in range(i + 1, len(near)) if int(near[i] ^ near[j]).bit_count() <= 4}


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_common_length():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        assert T6.common_length(a, b) == slow_lcs(a.tolist(), b.tolist())


def test_leaks(spark, docs, odd, none):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, words(re.sub(r"\W", " ", r.text.lower()))) for r in benchmark.collect()]
    want = set()
    for r in docs.collect():
        text = " " + " ".join(words(re.sub(r"\W", " ", r.text.lower()))) + " "
        want |= {(r.doc_id, k) for k, w in items if " " + " ".join(w) + " " in text}
    got = {(r.doc_id, r.item_id) for r in T6.find_leaks(docs, benchmark).select("row.doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()}
    assert want and want <= got and len(got - want) <= 2
    item = items[0][1]
    changed = " ".join(w if k % 9 else "other" for k, w in enumerate(item))
    para = spark.createDataFrame([(1, f"{' filler' * 30} {changed} {' filler' * 30}"), (2, " ".join(item[: len(item) // 2])), (3, None), (4, "")], "doc_id long, text string")
    found = T6.find_leaks(docs.select("doc_id", "text").unionByName(para.withColumn("doc_id", -F.col("doc_id"))), benchmark.limit(40))
    assert {r.doc_id for r in found.where("size(leaks) > 0 and row.doc_id < 0").select("row.doc_id").collect()} == {-1}
    assert T6.find_leaks(none, benchmark).isEmpty() and T6.find_leaks(odd, benchmark.limit(0)).where("size(leaks) > 0").isEmpty()
    assert T6.find_leaks(odd, benchmark).count() == len(odd_rows())


def test_transport_round_trip(spark, odd):
    for size in (0, 1, 100, 157, 158, 170, 183, 184, 185, 4096, 4097, 40_000):
        payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
        media = T7.write_stream(payload)
        read = T7.read_stream(media)
        assert len(media) % 188 == 0 and read["payload"] == payload and not read["errors"] and not read["discontinuities"]
        assert [s["random_access"] for s in read["stamps"]] == [k % 8 == 0 for k in range(len(read["stamps"]))]
        assert [s["pts"] for s in read["stamps"]] == [k * 3600 for k in range(len(read["stamps"]))]
        if size > 5000:
            assert T7.read_stream(media[: 188 * 6] + media[188 * 7 :])["discontinuities"] == 1
            assert T7.read_stream(media[: 188 * 6] + b"\0" + media[188 * 6 + 1 :])["errors"]
    assert T7.read_stream(None)["packets"] == 0 and T7.read_stream(b"junk")["errors"] == ["sync"]
    assert T7.crc32_mpeg(b"123456789") == 0x0376E6E7
    both = T7.read_streams(T7.write_streams(odd.select("doc_id", F.encode("text", "UTF-8").alias("p")), "p")).select("doc_id", F.col("read.payload").cast("string").alias("t"))
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(((k, t or "") for k, t, *_ in odd_rows()), key=repr)


def test_archives(spark):
    long = "<p>" + "y" * 1200
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, "short"), (4, "http://a/4", "short"), (5, "u\nv", None), (9, "http://a/9", long), (9, "http://a/9", long), (None, "http://a/x", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = T8.read_archives(T8.write_archives(pages)).collect()
    assert len(got) == len(rows) and not any(r.problems for r in got)
    kinds = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds.count(("<urn:page:9>", "response", None, 1203)) == 2 and ("<urn:page:1>", "revisit", "<urn:page:9>", 1203) in kinds and ("<urn:page:3>", "response", None, 5) in kinds
    assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() for r in got if r.record_type == "response")
    data = T8.write_archives(pages.repartition(1)).first().content
    assert len(list(T8.frames(data))) == len(rows)
    cut = list(T8.frames(data[:-5]))
    assert cut[-1][1] is None and len(cut) == len(rows)
    bad = T8.parse(T8.record(1, "u", b"abc", "0" * 40, None))
    assert bad["problems"] == ["digest"] and "version line" in T8.parse(b"junk")["problems"]
    assert T8.read_archives(spark.createDataFrame([("a", None), ("b", bytearray(b"junk junk"))], "archive string, content binary")).count() == 1
    assert T8.read_archives(T8.write_archives(pages.limit(0))).isEmpty()


def test_tokenizer_is_the_plain_call():
    tool = WordTokenizer(T9.default_tokenizer(), keep=5)
    odd = ["It's DON'T 12ab3, foo... ***bar### a'b", "ΑΣ ΣΑΣ σ İstanbul ǅ ẞ", "a<|endoftext|>b <|ENDOFTEXT|> x", "éa ́ x y\x1cz\x85q", "ﬁn ＡＢＣ ² Ⅷ ª", "日本語 テスト　あ", "x y  z ​", "", " \n"]
    for t, got in zip(odd, tool.encode([t.encode() for t in odd]), strict=True):
        assert got == np.array(tool.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing(spark, odd, none, docs):
    for frame in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        texts = {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}
        rows = T9.pack_documents(frame, T9.default_tokenizer(), capacity=256, piece=64, ways=4, fine=8, zone=32, slack=4).collect()
        tool = WordTokenizer(T9.default_tokenizer())
        by_doc, by_window = {}, {}
        for r in rows:
            assert len(r.ids) == 4 * r.length
            by_doc.setdefault(r.doc_id, []).append(r)
            by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert by_doc.keys() == texts.keys()
        for k, pieces in by_doc.items():
            pieces.sort(key=lambda r: r.start)
            want = tool.encode([texts[k].encode()])[0] + b"\1\0\0\0"
            assert b"".join(r.ids for r in pieces) == want and {r.doc_tokens for r in pieces} == {len(want) // 4}
        for w in by_window.values():
            w.sort()
            assert w[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(w, w[1:])) and sum(w[-1]) <= 256
        assert sum(r.length for r in rows) / 256 / len(by_window) > 0.85 or len(texts) < 50
    assert T9.pack_documents(none, T9.default_tokenizer()).isEmpty()


def test_window_count_rises_whenever_capacity_is_exceeded():
    """Runs of 60 in windows of 100: none can hold two, so the count goes from 2 to 4 with further runs and on without."""
    packer = T9.Packer(capacity=100, ways=2, piece=60, fine=60, zone=0, slack=1, first=0)
    rows = [r for k in range(12) for r in packer.add(k, bytes(4 * 60))]
    counts = packer.ways
    rows += list(packer.close(last=True)) if packer.open else []
    load = {}
    for r in rows:
        load[r[5]] = load.get(r[5], 0) + r[2]
    assert counts > 2 or len(load) > 7
    assert sum(load.values()) == 720 and max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    even = T9.Packer(capacity=100, ways=4, piece=40, fine=4, zone=12, slack=3, first=0)
    rows = [r for k in range(200) for r in even.add(k, bytes(4 * (7 + k % 90)))] + list(even.close(last=True))
    load = {}
    for r in rows:
        load[r[5]] = load.get(r[5], 0) + r[2]
    assert max(load.values()) <= 100 and sum(load.values()) / len(load) > 94


def test_differencing():
    rng = np.random.default_rng(6)
    for ways in (1, 2, 5):
        sizes = rng.integers(1, 500, 60).tolist()
        windows = T9.differencing(sizes, ways)
        sums = [sum(sizes[k] for k in w) for w in windows]
        assert sorted(k for w in windows for k in w) == list(range(60)) and max(sums) - min(sums) < 60
    assert T9.differencing([], 3) == [[], [], []]
    full = T9.balanced([60, 60, 60], 100)
    assert len(full) == 3


def test_slots(spark, odd, none, docs, tmp_path):
    for n, frame in enumerate((odd, docs)):
        at = f"{tmp_path}/{n}"
        got = T10.shard_records(frame, at, shards=4, slots=64, part_rows=5).collect()
        texts = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts), key=repr)
        for s in range(4):
            own = sorted(r.slot for r in got if r.shard == s)
            assert own == list(range(len(own)))
        version, last, hot = T10.read_map(spark, at)
        assert version == 2 and len(last) == 64 and bool(hot) == (frame is odd) and all(last[r.virtual_slot] == r.shard for r in got)
        assert T10.read_map(spark, at, 1)[1] == [k % 4 for k in range(64)]
    load = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
    assert max(load) - min(load) < 0.2 * sum(load) / 4
    assert T10.shard_records(none, f"{tmp_path}/none").isEmpty()


def test_a_stored_map_is_edited(spark, docs, tmp_path):
    at = f"{tmp_path}/map"
    first = {r.doc_id: (r.virtual_slot, r.shard) for r in T10.shard_records(docs, at, shards=4, slots=64).collect()}
    long = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), F.repeat(F.concat(F.lit("more "), F.coalesce("text", F.lit(""))), 3).alias("text")).where("doc_id % 3 = 0")
    both = docs.select("doc_id", "text").unionByName(long)
    records = T10.measured(both)
    assert T10.rebalance(records, at, shards=4) == 3
    (_, two, _), (_, three, _) = (T10.read_map(spark, at, v) for v in (2, 3))
    got = T10.placed(records, at).collect()
    moved = {k for k in range(64) if two[k] != three[k]}
    assert moved and len(moved) < 48 and all(three[r.virtual_slot] == r.shard for r in got)
    assert all((r.virtual_slot, r.shard) == first[r.doc_id] for r in got if r.doc_id < 10_000 and r.virtual_slot not in moved)
    load = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
    assert max(load) - min(load) < 0.2 * sum(load) / 4
    assert {r.doc_id: (r.virtual_slot, r.shard) for r in T10.placed(T10.measured(docs), at, version=2).collect()} == first
    assert T10.rebalance(records, at, shards=5) == 4 and set(T10.read_map(spark, at)[1]) == set(range(5))
    with pytest.raises(ValueError):
        T10.read_map(spark, at, 9)


def test_a_hot_text_is_in_the_map(spark, tmp_path):
    copies = spark.createDataFrame([(k, LONG) for k in range(200)] + [(1000 + k, f"text {k}") for k in range(50)], "doc_id long, text string")
    at = f"{tmp_path}/map"
    hot = [r for r in T10.shard_records(copies, at, shards=4, slots=64, part_rows=20).collect() if r.doc_id < 1000]
    load = [sum(r["size"] for r in hot if r.shard == s) for s in range(4)]
    assert max(load) < 1.3 * sum(load) / 4 and len(T10.read_map(spark, at)[2]) == 1
    again = {r.doc_id: r.shard for r in T10.placed(T10.measured(copies), at).collect()}
    assert all(again[r.doc_id] == r.shard for r in hot)
