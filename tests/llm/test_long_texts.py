"""Texts of megabytes in every operator and stage, and columns whose names clash with the operators' own."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelspark.llm import near_copies as NC
from voxelspark.llm import op1_tokens as T1
from voxelspark.llm import op2_toxicity as T2
from voxelspark.llm import op3_language as T3
from voxelspark.llm import op4_substrings as T4
from voxelspark.llm import op5_simhash as T5
from voxelspark.llm import op6_semantic as T6
from voxelspark.llm import op7_transport as T7
from voxelspark.llm import op9_packing as T9
from voxelspark.llm import op10_slots as T10

MB = 1 << 20
WORDS = " ".join(f"w{k * 7919 % 1_000_003}" for k in range(650_000))
LONG = {1: " " * (5 * MB), 2: "letters" * (5 * MB // 7), 3: WORDS, 4: "x" + "\n" * (5 * MB) + "y", 5: "short", 6: None, 7: "!" * (5 * MB), 8: "one line " * (5 * MB // 9)}
#: Names that the operators use inside.
CLASH = ["_text", "row", "leaks", "score", "kept", "n_removed", "n_words", "h", "body", "size", "fingerprint", "component_id", "node", "media", "read", "text_crc32", "lang_pred", "held_out", "doc"]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in LONG.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASH}).cache()


def test_ids_of_long_runs_are_those_of_the_whole_text():
    import public_tokenizers as public

    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        tool, length = T1.encoder(public.path(name), public.PATTERN)
        for text in ("a" + " " * 30_000 + "b", " " * 30_000, "\n" * 20_000 + " \t" * 9_000 + "x1", "é　" + " " * 15_000 + "!", "a" + " " * 12_000 + "b" + "\t" * 12_000):
            assert T1.token_ids(tool, text) == tool.encode_ordinary(text)
        for text in LONG.values():
            ids = np.array(T1.token_ids(tool, text or ""), np.int64)
            assert length[ids].sum() == len((text or "").encode())


def test_tokens_of_long_texts(long):
    import public_tokenizers as public

    cut = long.withColumn("sections", T1.pieces_of("text", 100_000))
    got = T1.attribute_tokens(cut, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, sections_col="sections", rule="split").groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.max("doc_tokens").alias("n"), F.max("end").alias("e")).collect()
    assert {r.doc_id: r.e for r in got} == {k: len(t or "") for k, t in LONG.items()} and all(abs(r.t - r.n) < 1e-3 for r in got)


def test_null_sections(spark):
    import public_tokenizers as public

    d = spark.createDataFrame([(1, "ab cd", [(0, 2), (None, 3), (1, None)]), (2, "x", None)], "doc_id long, text string, s array<struct<start:long,end:long>>")
    got = T1.attribute_tokens(d, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, sections_col="s").collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(1, 0, 2)]


def test_classifiers(long, spark):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in LONG], "doc_id long, quality int, toxic int")
    got = T2.fit_toxicity(long, labels).score(long)
    assert got.count() == len(LONG) and got.where("score is null or score < 0 or score > 1").isEmpty()
    said = T3.fit_language(long).predict(long).collect()
    assert len(said) == len(LONG) and {r.doc_id for r in said if r.lang_pred == "und"} == {1, 6, 7}


def test_repeats(long):
    got = {r.row.doc_id: r for r in T4.remove_repeats(long).collect()}
    n = {k: len((t or "").split()) for k, t in LONG.items()}
    assert {k: r.n_words for k, r in got.items()} == n and all(r.n_removed == 0 and r.row["kept"] == "mine kept" for r in got.values())
    assert got[3].kept == WORDS


def test_groups(long):
    twice = long.unionByName(long.withColumn("doc_id", F.col("doc_id") + 100))
    got = {r.doc_id: r for r in T5.simhash_groups(twice).collect()}
    assert all(got[k].component_id == got[k + 100].component_id for k in LONG) and got[3].fingerprint % 2**64 == T5.simhash(WORDS.encode())
    near = {r.doc_id: r.component_id for r in NC.near_copies(twice).collect()}
    assert {k: near[k] for k in LONG} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1, 7: 7, 8: 8} and all(near[k + 100] == near[k] for k in LONG)


def test_leaks(long, spark):
    item = "what stands in the middle of a text of five megabytes and is found there? the answer is this last part"
    planted = long.where("doc_id = 3").withColumn("text", F.concat("text", F.lit(" " + item + " "), "text")).unionByName(long.where("doc_id <> 3"))
    found = T6.find_leaks(planted, spark.createDataFrame([(1, item)], "item_id long, text string")).where("size(leaks) > 0").select("row.doc_id", "row.leaks", F.col("leaks")[0]["word"].alias("word")).collect()
    assert [(r.doc_id, r.leaks) for r in found] == [(3, "mine leaks")] and abs(found[0].word - 650_000) < 100


def test_transport(long):
    got = T7.read_streams(T7.write_streams(long.withColumn("p", F.encode("text", "UTF-8")), "p")).select("doc_id", F.sha2("read.payload", 256), "kept").collect()
    assert {r[0]: r[1] for r in got} == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in LONG.items()} and {r.kept for r in got} == {"mine kept"}


def test_packing(long):
    got = T9.pack_documents(long, T9.default_tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in got} == set(LONG) and all(r.n == r.t for r in got) and min(r.n for r in got if r.doc_id in (3, 7, 8)) > 300_000


def test_slots(long, tmp_path):
    got = T10.shard_records(long, f"{tmp_path}/map").collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {k: (len(t or "") + 1, zlib.crc32((t or "").encode())) for k, t in LONG.items()}


def test_stages(long, spark, tmp_path):
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that no document holds. it has an answer")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = long
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == long.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {r.doc_id: r.asDict() for r in docs.collect()}
    assert sorted(kept) == [1, 2, 3, 4, 5, 7, 8] and all(kept[k][c] == f"mine {c}" for k in kept for c in CLASH)
    assert kept[3]["text"] == WORDS and re.sub(r"\s", "", kept[1]["text"]) == ""
