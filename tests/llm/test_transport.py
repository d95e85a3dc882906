"""Streams that another writer made: packets built by hand from the format's fields."""

import struct

from pyspark.sql import functions as F

from voxelspark.llm import op7_transport as T


def ts(pid, counter, body, start=False, error=False, scrambled=0, field=None):
    """One packet, padded by an adaptation field."""
    room = 184 - len(body)
    head = bytes([0x47, error << 7 | start << 6 | pid >> 8, pid & 255, scrambled << 6 | (0x30 if room else 0x10) | counter & 15])
    if not room:
        return head + body
    inner = (field or b"\0") if room > 1 else b""
    return head + bytes([room - 1]) + inner + b"\xff" * (room - 1 - len(inner)) + body


def psi(table, number, body, version=0, now=1):
    head = bytes([table]) + struct.pack(">H", 0xB000 | len(body) + 9) + struct.pack(">H", number) + bytes([0xC0 | version << 1 | now, 0, 0])
    return head + body + struct.pack(">I", T.crc32_mpeg(head + body))


def spread(pid, data, counter=0):
    """A section or PES packet over as many packets as it takes."""
    return [ts(pid, counter + k, data[at : at + 184], start=not at) for k, at in enumerate(range(0, len(data), 184))]


def clock(mark, t):
    return bytes([mark << 4 | (t >> 30) << 1 | 1]) + struct.pack(">HH", (t >> 15 & 0x7FFF) << 1 | 1, (t & 0x7FFF) << 1 | 1)


def pes(stream, body, pts=None, dts=None):
    if stream in T.PLAIN:
        return b"\0\0\1" + bytes([stream]) + struct.pack(">H", len(body)) + body
    times = b"" if pts is None else clock(2, pts) if dts is None else clock(3, pts) + clock(1, dts)
    flags = 0 if pts is None else 0x80 if dts is None else 0xC0
    return b"\0\0\1" + bytes([stream]) + struct.pack(">H", len(body) + 3 + len(times)) + bytes([0x80, flags, len(times)]) + times + body


PAT = psi(0, 1, struct.pack(">HH", 7, 0xE000 | 0x50))


def pmt(streams, more=b"", **how):
    entries = b"".join(bytes([kind]) + struct.pack(">HH", 0xE000 | pid, 0xF000 | len(more)) + more for kind, pid in streams)
    return psi(2, 7, struct.pack(">HH", 0xE000 | streams[0][1], 0xF000) + entries, **how)


def lead(streams, more=b""):
    return [*spread(0, b"\0" + PAT), *spread(0x50, b"\0" + pmt(streams, more))]


def test_a_packet_may_come_twice():
    parts = spread(0x60, pes(0xE0, b"a" * 700, pts=90_000))
    for k in range(len(parts)):
        read = T.read_stream(b"".join([*lead([(0x1B, 0x60)]), *parts[: k + 1], parts[k], *parts[k + 1 :]]))
        assert read["payload"] == b"a" * 700 and not read["discontinuities"] and not read["errors"]
    third = T.read_stream(b"".join([*lead([(0x1B, 0x60)]), parts[0], parts[1], parts[1], parts[1], *parts[2:]]))
    assert third["discontinuities"] == 1
    lost = T.read_stream(b"".join([*lead([(0x1B, 0x60)]), parts[0], *parts[2:]]))
    assert lost["discontinuities"] == 1 and lost["errors"] == ["pes length"]


def test_sections_longer_than_a_packet():
    long = pmt([(0x1B, 0x60), (0x0F, 0x61)], b"\x0a" * 200)
    assert len(long) > 400
    read = T.read_stream(b"".join([*spread(0, b"\0" + PAT), *spread(0x50, b"\0" + long), *spread(0x60, pes(0xE0, b"video", 5)), *spread(0x61, pes(0xC0, b"sound", 6))]))
    assert [(s["pid"], s["program"], s["stream_type"]) for s in read["streams"]] == [(0x60, 7, 0x1B), (0x61, 7, 0x0F)] and not read["errors"]
    # a section that ends behind the pointer of the next one
    one, two = psi(0x42, 1, b"x" * 180), PAT
    both = one + two
    packets = [ts(0, 0, b"\0" + both[:183], start=True), ts(0, 1, bytes([len(one) - 183]) + both[183:], start=True)]
    assert T.read_stream(b"".join(packets))["programs"] == [7] and not T.read_stream(b"".join(packets))["errors"]
    short = T.read_stream(b"".join(spread(0x0, b"\0" + psi(0, 1, b"\0\7\xe0\x50" * 60))[:1]))
    assert short["errors"] == ["pat"]


def test_streams_keep_their_own_bytes_and_times():
    video = [pes(0xE0, b"v%d" % k * 100, pts=3000 * k + 6000, dts=3000 * k) for k in range(3)]
    sound = [pes(0xC0, b"s%d" % k * 30, pts=2**33 - 1 - k) for k in range(2)]
    other = [pes(0xBF, b"private"), pes(0xBE, b"\xff" * 40)]
    packets, count = lead([(0x1B, 0x60), (0x0F, 0x61), (0x06, 0x62)]), {}
    for pid, data in ((0x61, sound[0]), (0x60, video[0]), (0x62, other[0]), (0x60, video[1]), (0x61, sound[1]), (0x62, other[1]), (0x60, video[2])):
        new = spread(pid, data, count.get(pid, 0))
        count[pid] = count.get(pid, 0) + len(new)
        packets += new
    read = T.read_stream(b"".join(packets))
    assert not read["errors"] and not read["discontinuities"]
    own = {s["pid"]: read["payload"][s["offset"] : s["offset"] + s["length"]] for s in read["streams"]}
    assert own == {0x60: b"".join(b"v%d" % k * 100 for k in range(3)), 0x61: b"s0" * 30 + b"s1" * 30, 0x62: b"private"}
    assert [(s["pts"], s["dts"]) for s in read["stamps"] if s["pid"] == 0x60] == [(6000, 0), (9000, 3000), (12000, 6000)]
    assert [(s["pts"], s["dts"]) for s in read["stamps"] if s["pid"] == 0x61] == [(2**33 - 1, None), (2**33 - 2, None)]
    assert all(read["payload"][s["offset"] : s["offset"] + s["length"]] in (b"s0" * 30, b"s1" * 30) for s in read["stamps"] if s["pid"] == 0x61)


def test_marked_packets_are_not_taken_in():
    parts = spread(0x60, pes(0xE0, b"b" * 500, 1))
    bad = bytearray(parts[1])
    bad[1] |= 0x80
    assert "transport error" in T.read_stream(b"".join([*lead([(0x1B, 0x60)]), parts[0], bytes(bad), *parts[2:]]))["errors"]
    hidden = bytearray(parts[1])
    hidden[3] |= 0x80
    read = T.read_stream(b"".join([*lead([(0x1B, 0x60)]), parts[0], bytes(hidden), *parts[2:]]))
    assert "scrambled" in read["errors"] and not read["discontinuities"]
    jump = ts(0x60, 9, pes(0xE0, b"c", 2), start=True, field=b"\x80")
    assert not T.read_stream(b"".join([*lead([(0x1B, 0x60)]), *parts, jump]))["discontinuities"]
    nothing = [ts(0x1FFF, 3, b"z" * 184), ts(0x1FFF, 3, b"z" * 184)]
    assert T.read_stream(b"".join([*nothing, *lead([(0x1B, 0x60)]), *parts]))["payload"] == b"b" * 500


def test_tables_change_when_they_are_in_force():
    first, later = pmt([(0x1B, 0x60)]), pmt([(0x1B, 0x61)], version=1, now=0)
    packets = [*spread(0, b"\0" + PAT), *spread(0x50, b"\0" + first), *spread(0x50, b"\0" + later, 1), *spread(0x60, pes(0xE0, b"old", 1))]
    assert T.read_stream(b"".join(packets))["payload"] == b"old"
    packets += [*spread(0x50, b"\0" + pmt([(0x1B, 0x61)], version=1), 2), *spread(0x61, pes(0xE0, b"new", 1))]
    read = T.read_stream(b"".join(packets))
    assert read["payload"] == b"oldnew" and {s["pid"]: s["stream_type"] for s in read["streams"]} == {0x60: None, 0x61: 0x1B}


def test_reading_goes_on_behind_junk():
    packets = [*lead([(0x1B, 0x60)]), *spread(0x60, pes(0xE0, b"d" * 900, 1))]
    read = T.read_stream(b"".join([*packets[:3], b"junk" * 5, *packets[3:]]))
    assert read["errors"] == ["sync"] and read["payload"] == b"d" * 900


def test_columns_of_the_same_name(spark):
    d = spark.createDataFrame([(1, b"abc", "m", "r"), (2, None, None, None)], "doc_id long, p binary, media string, read string")
    got = T.read_streams(T.write_streams(d, "p")).select("doc_id", F.col("read.payload").cast("string")).collect()
    assert sorted(map(tuple, got)) == [(1, "abc"), (2, "")]
