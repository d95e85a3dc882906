"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive is one binary value: skippable frame 0x184D2A5D with the dictionary (itself plain or compressed), then a frame for
each record. ``read_archives`` takes any frame with such a column, be it a table or ``spark.read.format("binaryFile")``, loads
the dictionary, decodes frame by frame and checks each record: version line, mandatory headers, Content-Length against the
block, payload digest against the payload. What is wrong is listed in ``problems``; other records are still read, those behind a
bad frame too.

Payloads of at least ``least`` bytes that occur again are stored once: the row with the largest id is the response, the others
are revisits that refer to it. Digests are aggregated before they are joined, and html itself is shuffled once, by id. A task holds
one archive in its packed form, one batch and the records that train the dictionary (3 MB).

Edge cases: null html is an empty payload; null url is left out of the header; rows with a null id are responses; repeated rows
give repeated records.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import text_bytes
from voxelspark.plans.iterate import Scratch

DICT_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
#: Fixed values of the format.
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes that the decoder is fed at once, and that a batch of read records holds at most (but for its last record).
FEED, BATCH = 1 << 14, 4 << 20


def record(page, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block, b"", b""])


class Archive:
    """One archive as it grows: records are packed as they come, only those that train the dictionary wait for it."""

    def __init__(self, level: int = 3, dictionary_bytes: int = 1 << 15):
        self.level, self.dictionary_bytes = level, dictionary_bytes
        self.waiting, self.out, self.size, self.pack = [], [], 0, None

    def add(self, one: bytes) -> None:
        self.size += len(one)
        if self.pack:
            self.out.append(self.pack.compress(one))
            return
        self.waiting.append(one)
        if self.size > 100 * self.dictionary_bytes:
            self._train()

    def _train(self) -> None:
        try:
            trained = zstandard.train_dictionary(self.dictionary_bytes, self.waiting).as_bytes()
        except zstandard.ZstdError:  # too few samples: the first record's head serves as it is
            trained = self.waiting[0][: self.dictionary_bytes]
        self.pack = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
        self.out += [struct.pack("<II", DICT_FRAME, len(trained)), trained, *map(self.pack.compress, self.waiting)]
        self.waiting = []

    def close(self) -> bytes:
        if self.waiting:
            self._train()
        return b"".join(self.out)


def archive(records: list[bytes], **how) -> bytes:
    whole = Archive(**how)
    for one in records:
        whole.add(one)
    return whole.close()


def parse(raw: bytes) -> dict:
    """One record's fields and what is wrong with it."""
    problems = []
    end = raw.find(b"\r\n\r\n")
    lines = raw[: end if end >= 0 else 1 << 16].split(b"\r\n")
    if end < 0 or not lines[0].startswith(b"WARC/"):
        problems.append("version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            problems.append("header line")
        headers[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    problems += [f"no {k}" for k in MANDATORY if k not in headers]
    said = headers.get("Content-Length", "")
    size = int(said) if said.isdigit() else -1
    at = end + 4 if end >= 0 else len(raw)
    if size < 0 or len(raw) != at + size + 4 or raw[-4:] != b"\r\n\r\n":
        problems.append("length")
    last = min(len(raw), at + max(size, 0))
    split = raw.find(b"\r\n\r\n", at, last)
    http, body = raw[at : split if split >= 0 else last], split + 4 if split >= 0 else last
    claim = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = headers.get("WARC-Type")
    payload = raw[body:last] if kind != "revisit" else None
    if kind == "response" and digest and hashlib.sha1(payload).hexdigest() != digest:
        problems.append("digest")
    if kind == "response" and claim.isdigit() and int(claim) != len(payload):
        problems.append("http length")
    return {
        "record_type": kind, "record_id": headers.get("WARC-Record-ID"), "target_uri": headers.get("WARC-Target-URI"), "refers_to": headers.get("WARC-Refers-To"),
        "payload_digest": digest or None, "payload_bytes": int(claim) if claim.isdigit() else None, "headers": list(headers.items()), "payload": payload, "problems": problems,
    }


def next_frame(data: bytes, at: int) -> int:
    """Where the next frame's magic stands, at or after ``at``; the end of the data if nowhere."""
    found = data.find(struct.pack("<I", ZSTD_FRAME), at)
    return found if found >= 0 else len(data)


def frames(data: bytes):
    """(offset, record, what is wrong) of each frame; the leading skippable frame may hold a dictionary.

    A frame is fed to the decoder in slices until it ends, so an archive costs its length. After bytes that are no whole frame
    reading goes on at the next frame magic.
    """
    at, trained = 0, b""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        trained, at = data[8 : 8 + size], 8 + size
        if trained[:4] == struct.pack("<I", ZSTD_FRAME):
            try:
                trained = zstandard.ZstdDecompressor().decompressobj().decompress(trained)
            except zstandard.ZstdError as e:
                yield 0, None, f"dictionary: {e}"
                trained = b""
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one, parts, fed, wrong = tool.decompressobj(), [], at, None
        try:
            while not one.eof and fed < len(data):
                parts.append(one.decompress(view[fed : fed + FEED]))
                fed = min(len(data), fed + FEED)
        except zstandard.ZstdError as e:
            wrong = str(e)
        if wrong or not one.eof:
            yield at, None, wrong or "frame cut short"
            at = next_frame(data, at + 1)
            continue
        yield at, b"".join(parts), None
        at = fed - len(one.unused_data)


RECORD = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string())]
    + [("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("problems", pa.list_(pa.string()))]
)
RECORD_DDL = "archive string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary, problems array<string>"


def read_archives(df: DataFrame, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """One row per record of every archive."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                name, data, rows, held = b.column(0)[k].as_py(), b.column(1)[k].as_py() or b"", [], 0
                for offset, raw, wrong in frames(data):
                    rows.append({"archive": name, "offset": offset} | ({"problems": [wrong]} if raw is None else parse(raw)))
                    held += len(raw or b"")
                    if len(rows) == 500 or held >= BATCH:
                        yield from pa.Table.from_pylist(rows, RECORD).to_batches()
                        rows, held = [], 0
                if rows:
                    yield from pa.Table.from_pylist(rows, RECORD).to_batches()

    return df.select(name_col, content_col).mapInArrow(run, RECORD_DDL)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, archive_bytes: int = 8 << 20, salts: int = 16) -> DataFrame:
    """(archive, content): archives of about ``archive_bytes`` of records, each from one task.

    Rows of one payload meet their response over ``salts`` keys, so that a page with many copies is no single key.
    """
    body = text_bytes(html_col)
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), body.alias("body"))
    salt = F.pmod(F.xxhash64("page"), F.lit(salts)).cast("int").alias("salt")
    marks = rows.select("page", F.sha1("body").alias("digest"), F.octet_length("body").alias("size"), salt).where((F.col("size") >= least) & F.col("page").isNotNull())
    kept = marks.groupBy("digest", "size").agg(F.max("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = kept.select("digest", "size", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    again = marks.join(kept, ["digest", "size", "salt"]).where("page <> refers_to").select("page", "digest", "refers_to").distinct()
    told = rows.withColumn("digest", F.sha1("body")).join(again, ["page", "digest"], "left").select("page", "url", "body", "digest", "refers_to")

    def run(batches):
        from pyspark import TaskContext

        task, number, whole = TaskContext.get().partitionId(), 0, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:04d}.warc.zst"]), pa.array([whole.close()], pa.binary())], ["archive", "content"])

        for b in batches:
            for k in range(b.num_rows):
                whole = whole or Archive()
                whole.add(record(*(c[k].as_py() for c in b.columns)))
                if whole.size >= archive_bytes:
                    yield out()
                    number, whole = number + 1, None
        if whole:
            yield out()

    return told.mapInArrow(run, "archive string, content binary")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    stored = Scratch(spark, "warc").settle(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1)
    return read_archives(stored).select(
        F.when(page != "", page).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]+)>$", 1).cast("long").alias("refers_to"),
    )
