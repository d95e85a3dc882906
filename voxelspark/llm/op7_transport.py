"""MPEG transport streams as a binary column.

Writing: a payload is cut into access units, each a PES packet with a presentation time stamp, carried by 188-byte transport
packets of one elementary stream; program tables lead the stream and come again before every random access point.

Reading: packets are checked for their sync byte; after bytes that are no packet, reading goes on at the next two sync bytes a
packet apart. The program association table names the program map tables, which name the elementary streams; sections may span
packets and share them, are checked by their CRC and take effect if they are current; a new version replaces the older one.
Continuity counters of every stream are followed; a packet may come twice, the second is not taken in. Packets with the error
bit or scrambled ones are not taken in and are errors. PES packets, with or without an optional header, are put together again
and their time stamps (presentation and decoding), places and random access flags kept, each with its stream's pid.

Each row is one stream, written and read inside a task; nothing is shuffled. Edge cases: a null or empty column reads as a
stream without packets; bytes that do not parse give ``errors`` and what else was read, never an exception; repeated rows are
written each, equal payloads as equal streams; a column that is there already under the name of the new one is replaced.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelspark.llm.common import text_bytes
from voxelspark.plans.iterate import Scratch
from voxelspark.plans.iterate import bounded_batches

PACKET, BODY = 188, 184
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x1000, 0x0100
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD
CLOCK = 90_000
STAMPS = "array<struct<pid:int,pts:long,dts:long,offset:long,length:long,random_access:boolean>>"
STREAMS = "array<struct<pid:int,program:int,stream_type:int,offset:long,length:long>>"
#: Stream ids of PES packets without an optional header, the one that only pads, and the pid of packets that carry nothing.
PLAIN, PADDING, NULL_PID = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE, 0x1FFF


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
    return c & 0xFFFFFFFF


CRC = [_crc_step(i << 24) for i in range(256)]


@lru_cache(maxsize=256)
def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


PAT = section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
PMT = section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, STREAM_TYPE, 0xE000 | STREAM_PID, 0xF000))


def packet(pid: int, start: bool, counter: int, body: bytes, field: bytes | None = None) -> bytes:
    """One transport packet; ``field``: flags and more of an adaptation field; a short body is led by stuffing."""
    room = BODY - len(body)
    head = struct.pack(">BHB", 0x47, start << 14 | pid, (0x30 if room else 0x10) | counter & 15)
    if not room:
        return head + body
    if room == 1:
        return head + b"\0" + body
    field = field or b"\0"
    return head + bytes([room - 1]) + field + b"\xff" * (room - 1 - len(field)) + body


def stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | pts >> 29 & 0x0E, pts >> 14 & 0xFFFE | 1, pts << 1 & 0xFFFE | 1)


def write_stream(payload: bytes, unit: int = 4096, every: int = 8, step: int = CLOCK // 25) -> bytes:
    """A stream whose access units hold ``unit`` bytes each; every ``every``-th one can be tuned in at."""
    out, tables, counter = [], 0, 0
    for k, at in enumerate(range(0, len(payload), unit)):
        body, pts = payload[at : at + unit], k * step & (1 << 33) - 1
        entry = k % every == 0
        if entry:
            out += [packet(PAT_PID, True, tables, b"\0" + PAT + b"\xff" * (BODY - 1 - len(PAT))), packet(PMT_PID, True, tables, b"\0" + PMT + b"\xff" * (BODY - 1 - len(PMT)))]
            tables += 1
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(body) + 8, 0x84, 0x80, 5) + stamp(pts) + body
        field = b"\x50" + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00) if entry else None  # random access, clock
        take = min(len(pes), BODY - 1 - len(field) if field else BODY)
        out.append(packet(STREAM_PID, True, counter, pes[:take], field))
        counter += 1
        for i in range(take, len(pes), BODY):
            out.append(packet(STREAM_PID, False, counter, pes[i : i + BODY]))
            counter += 1
    return b"".join(out)


def time_stamp(pes: bytes, at: int) -> int:
    a, b, c = struct.unpack_from(">BHH", pes, at)
    return (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1


class Sections:
    """Table sections of one pid, put together from packets."""

    def __init__(self):
        self.held = None  # bytes of the section that is open, None if none is

    def feed(self, body: bytes, start: bool):
        """Sections that are whole now."""
        if start:
            first = 1 + (body[0] if body else 0)
            if self.held is not None:
                self.held += body[1:first]
                yield from self._whole()
            self.held = body[first:]
        elif self.held is not None:
            self.held += body
        yield from self._whole()

    def _whole(self):
        while self.held:
            if self.held[0] == 0xFF:  # stuffing up to the packet's end
                self.held = None
                return
            size = 3 + (struct.unpack_from(">H", self.held, 1)[0] & 0x0FFF) if len(self.held) >= 3 else 3
            if len(self.held) < size:
                return
            found, self.held = self.held[:size], self.held[size:]
            yield found
        if self.held is not None and not self.held:
            self.held = None


class Reader:
    """One stream as its packets come."""

    def __init__(self):
        self.errors: list[str] = []
        self.maps: dict[int, int] = {}  # pid of a program map: program
        self.streams: dict[int, tuple[int, int]] = {}  # pid: program, stream type
        self.versions: dict[tuple[int, int], int] = {}
        self.last: dict[int, tuple[int, bytes, bool]] = {}  # pid: counter, payload, whether it came twice already
        self.tables: dict[int, Sections] = {}
        self.open: dict[int, tuple[list[bytes], bool]] = {}
        self.found: dict[int, tuple[list[bytes], list[dict]]] = {}
        self.breaks = self.packets = 0

    def _new_version(self, table: int, number: int, byte: int) -> bool:
        """Whether a section's version is not the one known; then what the older one said goes."""
        version = byte >> 1 & 31
        if self.versions.get((table, number)) == version:
            return False
        self.versions[table, number] = version
        return True

    def table(self, pid: int, found: bytes) -> None:
        if len(found) < 12 or crc32_mpeg(found):
            self.errors.append("pat" if pid == PAT_PID else "pmt")
            return
        number, byte = struct.unpack_from(">HB", found, 3)
        if not byte & 1:  # not in force yet
            return
        if pid == PAT_PID and found[0] == 0x00:
            if self._new_version(0, number, byte):
                self.maps = {}
            for i in range(8, len(found) - 4, 4):
                program, to = struct.unpack_from(">HH", found, i)
                if program:
                    self.maps[to & 0x1FFF] = program
        elif pid != PAT_PID and found[0] == 0x02:
            if self._new_version(2, number, byte):
                self.streams = {k: v for k, v in self.streams.items() if v[0] != number}
            i = 12 + (struct.unpack_from(">H", found, 10)[0] & 0x0FFF)
            while i + 5 <= len(found) - 4:
                kind, to, more = struct.unpack_from(">BHH", found, i)
                self.streams[to & 0x1FFF] = (number, kind)
                i += 5 + (more & 0x0FFF)

    def finish(self, pid: int) -> None:
        """Takes in the PES packet that is open."""
        parts, entry = self.open.pop(pid, ([], False))
        pes = b"".join(parts)
        if not pes:
            return
        if len(pes) < 6 or pes[:3] != b"\0\0\1":
            self.errors.append("pes start")
            return
        said, plain = struct.unpack_from(">H", pes, 4)[0], pes[3] in PLAIN
        if said and said != len(pes) - 6:
            self.errors.append("pes length")
        head, pts, dts = 6, None, None
        if not plain:
            if len(pes) < 9 or pes[6] >> 6 != 2 or len(pes) < 9 + pes[8]:
                self.errors.append("pes head")
                return
            head = 9 + pes[8]
            pts = time_stamp(pes, 9) if pes[7] & 0x80 and pes[8] >= 5 else None
            dts = time_stamp(pes, 14) if pes[7] & 0xC0 == 0xC0 and pes[8] >= 10 else None
        if pes[3] == PADDING:
            return
        bodies, stamps = self.found.setdefault(pid, ([], []))
        bodies.append(pes[head:])
        stamps.append({"pid": pid, "pts": pts, "dts": dts, "offset": sum(s["length"] for s in stamps[-1:]) + (stamps[-1]["offset"] if stamps else 0), "length": len(pes) - head, "random_access": entry})

    def packet(self, p: bytes) -> None:
        self.packets += 1
        pid, flags = struct.unpack_from(">HB", p, 1)
        wrong, start, pid, has, counter = pid & 0x8000, bool(pid & 0x4000), pid & 0x1FFF, flags >> 4 & 3, flags & 15
        if wrong:
            self.errors.append("transport error")
            return
        if pid == NULL_PID:
            return
        body, entry, jump = 4, False, False
        if has & 2:
            size = p[4]
            entry, jump = (bool(p[5] & 0x40), bool(p[5] & 0x80)) if size else (False, False)
            body = 5 + size
        if body > PACKET:
            self.errors.append("adaptation")
            return
        if not has & 1:
            return
        body = p[body:]
        before = self.last.get(pid)
        if before and not jump:
            if counter == before[0] and body == before[1] and not before[2]:
                self.last[pid] = (counter, body, True)
                return
            if counter != before[0] + 1 & 15:
                self.breaks += 1
                self.tables.pop(pid, None)
        self.last[pid] = (counter, body, False)
        if flags & 0xC0:
            self.errors.append("scrambled")
        elif pid == PAT_PID or pid in self.maps:
            for found in self.tables.setdefault(pid, Sections()).feed(body, start):
                self.table(pid, found)
        elif pid in self.streams:
            if start:
                self.finish(pid)
                self.open[pid] = ([body], entry)
            elif pid in self.open:
                self.open[pid][0].append(body)
            else:
                self.errors.append("pes middle")

    def close(self) -> dict:
        for pid in list(self.open):
            self.finish(pid)
        self.errors += ["pat" if pid == PAT_PID else "pmt" for pid, t in self.tables.items() if t.held]
        payload, stamps, streams, at = [], [], [], 0
        for pid in sorted(self.found.keys() | self.streams.keys()):
            bodies, own = self.found.get(pid, ([], []))
            size, (program, kind) = sum(map(len, bodies)), self.streams.get(pid, (None, None))
            streams.append({"pid": pid, "program": program, "stream_type": kind, "offset": at, "length": size})
            stamps += [s | {"offset": s["offset"] + at} for s in own]
            payload += bodies
            at += size
        return {"packets": self.packets, "programs": sorted(set(self.maps.values())), "streams": streams, "discontinuities": self.breaks, "errors": self.errors, "payload": b"".join(payload), "stamps": stamps}


def next_packet(data: bytes, at: int) -> int:
    """Where the next packet starts, at or after ``at``: a sync byte that another one, or the end, follows a packet later."""
    while (at := data.find(b"\x47", at)) >= 0:
        if at + PACKET == len(data) or (at + PACKET < len(data) and data[at + PACKET] == 0x47):
            return at
        at += 1
    return len(data)


def read_stream(data: bytes | None) -> dict:
    """{packets, programs, streams, discontinuities, errors, payload, stamps} of one stream.

    payload: all elementary streams, one after the other by pid; streams and stamps tell each one's place in it.
    """
    data, at, reader = data or b"", 0, Reader()
    while at < len(data):
        if at + PACKET > len(data) or data[at] != 0x47:
            reader.errors.append("sync")
            at = next_packet(data, at + 1)
            continue
        reader.packet(data[at : at + PACKET])
        at += PACKET
    return reader.close()


READ = pa.struct(
    [("packets", pa.int64()), ("programs", pa.list_(pa.int32())), ("streams", pa.list_(pa.struct([("pid", pa.int32()), ("program", pa.int32()), ("stream_type", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))]
    + [("discontinuities", pa.int64()), ("errors", pa.list_(pa.string())), ("payload", pa.binary())]
    + [("stamps", pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_())])))]
)


def write_streams(df: DataFrame, payload_col: str, media_col: str = "media") -> DataFrame:
    """``df`` with each payload stored as a transport stream in ``media_col``; the payload column goes."""
    rest = [c for c in df.columns if c not in (payload_col, media_col)]
    schema = df.select(*rest).schema
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                media = pa.array([write_stream(x or b"") for x in s.column(0).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*s.columns[1:], media], [*rest, media_col])

    return df.select(payload_col, *rest).mapInArrow(run, schema.add(media_col, "binary"))


def read_streams(df: DataFrame, media_col: str = "media", into: str = "read") -> DataFrame:
    """``df`` with a struct ``into`` of what its streams hold."""
    rest = [c for c in df.columns if c != into]
    schema = df.select(*rest).schema
    bounded_batches(df.sparkSession)
    kind = T.StructType.fromDDL(f"x struct<packets:long,programs:array<int>,streams:{STREAMS},discontinuities:long,errors:array<string>,payload:binary,stamps:{STAMPS}>")["x"].dataType

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                read = pa.array([read_stream(x) for x in s.column(media_col).to_pylist()], READ)
                yield pa.RecordBatch.from_arrays([*s.columns, read], [*rest, into])

    return df.select(*rest).mapInArrow(run, schema.add(into, kind))


def op7_transport(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.octet_length(text_bytes())
    padded = F.greatest(F.lit(64), F.ceil(size / 64) * 64).cast("int")
    body = F.rpad(text_bytes(), padded, F.lit(b"\0"))
    stored = Scratch(spark, "transport").settle(write_streams(docs.select("doc_id", size.cast("long").alias("n_bytes"), body.alias("payload")), "payload"))
    r = F.col("read")
    entries = F.size(F.filter(r["stamps"], lambda s: s["random_access"]))
    feature = F.concat_ws(":", r["packets"], F.size(r["stamps"]), entries, F.element_at(r["stamps"], -1)["pts"], r["discontinuities"], F.size(r["errors"]))
    return read_streams(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length(r["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(r["payload"], 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(read.payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
