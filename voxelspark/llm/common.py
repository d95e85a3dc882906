"""What several text operators share: columns, Arrow helpers and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: An odd multiplier, its inverse modulo 2**64, and the multipliers of the final mix.
R, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
R_INV = pow(R, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn labels from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX2)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, np.uint64(base)
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        step = step * step
        have += take
    return out[:n]


class Powers:
    """Powers of R and of its inverse, kept between batches."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            with np.errstate(over="ignore"):
                self.up, self.down = powers(R, n), powers(R_INV, n)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, from one running sum of values times powers."""
    up, down = POWERS(len(values) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[:-1], out=run[1:])
        return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) in bytes of every word of documents that lie one after the other, and each document's first word (n+1 entries).

    between: for each byte value, whether it parts words.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[doc_start] = edge[doc_end] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    first = np.append(np.searchsorted(start, doc_start), len(start))
    return start, end, first


def byte_chunks(column: pa.Array, limit: int = 4 << 20):
    """(first row, rows, data, starts, ends) for runs of about ``limit`` bytes of a binary or string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(wide):
        stop = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        stop = min(stop, len(wide))
        base = off[row]
        yield row, stop - row, raw[base : off[stop]], off[row:stop] - base, off[row + 1 : stop + 1] - base
        row = stop


def planes(x: np.ndarray) -> bytes:
    """Little-endian integers as one run of bytes per byte place: high places are mostly zero and compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(data: memoryview, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)
