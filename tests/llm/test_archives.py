"""Archives with bad frames and with very long pages."""

import struct
import time

from pyspark.sql import functions as F

from voxelspark.llm import op8_warc as T8


def some(n, size=300):
    return [T8.record(k, f"http://a/{k}", (f"page {k} " * size).encode(), T8.hashlib.sha1((f"page {k} " * size).encode()).hexdigest(), None) for k in range(n)]


def test_reading_goes_on_behind_a_bad_frame(spark):
    data = bytearray(T8.archive(some(30)))
    offsets = [at for at, *_ in T8.frames(bytes(data))]
    for k in range(offsets[10] + 8, offsets[11]):
        data[k] ^= 0x5A
    got = spark.createDataFrame([("a", bytes(data))], "archive string, content binary")
    rows = T8.read_archives(got).collect()
    good = [r.record_id for r in rows if not r.problems]
    assert [f"<urn:page:{k}>" for k in range(30) if k != 10] == good and any(r.problems and r.offset == offsets[10] for r in rows)
    junk = bytes(data[: offsets[5]]) + b"junk" * 9 + bytes(data[offsets[5] : offsets[10]])
    found = list(T8.frames(junk))
    assert sum(raw is not None for _, raw, _ in found) == 10 and sum(raw is None for _, raw, _ in found) == 1


def test_an_archive_costs_its_length():
    took = {}
    for n in (2_000, 8_000):
        data = T8.archive(some(n, 20))
        began = time.process_time()
        assert sum(raw is not None for _, raw, _ in T8.frames(data)) == n
        took[n] = time.process_time() - began
    assert took[8_000] < 12 * took[2_000] + 0.5


def test_a_page_of_fifty_megabytes(spark):
    pages = spark.range(4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("0123456789"), 5_000_000)).otherwise("short").alias("html"))
    got = {r.record_id: r for r in T8.read_archives(T8.write_archives(pages)).select("record_id", "record_type", "refers_to", "payload_bytes", "problems", F.sha1("payload").alias("s"), "payload_digest").collect()}
    assert not any(r.problems for r in got.values()) and got["<urn:page:2>"].payload_bytes == 50_000_000 and got["<urn:page:2>"].s == got["<urn:page:2>"].payload_digest
    assert got["<urn:page:0>"].refers_to == "<urn:page:2>" and got["<urn:page:1>"].record_type == "response"


def test_many_copies_of_a_page(spark):
    pages = spark.range(2_000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit("z" * 1500).alias("html"))
    kinds = T8.read_archives(T8.write_archives(pages, archive_bytes=1 << 16)).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in kinds) == [("response", None, 1), ("revisit", "<urn:page:1999>", 1999)]


def test_a_dictionary_may_be_compressed():
    records = some(40)
    data = T8.archive(records)
    size = struct.unpack_from("<I", data, 4)[0]
    packed = T8.zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", T8.DICT_FRAME, len(packed)) + packed + data[8 + size :]
    assert [raw for _, raw, _ in T8.frames(again)] == records
