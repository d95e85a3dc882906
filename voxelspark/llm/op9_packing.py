"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

Documents are encoded whole and closed with an end id. Whole windows are cut off a long document first; what remains is cut
into runs of at most ``piece`` ids, and runs are gathered into groups that fill ``ways`` windows but for a small slack; a group's
last ``zone`` ids per window are cut into runs of at most ``fine`` ids, which even out the rest. Each group is divided by
differencing: every run starts as a partial partition of one full and many empty windows; the two partial partitions with the
largest imbalance merge, the fullest windows of one meeting the emptiest of the other, until one partition is left whose windows
are nearly equal. Whenever a window exceeds the capacity, the group's window count rises by one: it takes further runs for that
window and is divided anew; from twice ``ways`` windows on, and for the last group of a task, the count rises without further
runs until all windows fit. Runs of a document that follow each other in a window are one piece.

Groups form inside the tasks that read the documents: nothing is shuffled, and a task holds one group and one batch at a time.
A sequence's number is its task's number times 2**40 plus its place, so a retried task gives the same numbers.

Edge cases: null or empty text is the end id alone; a text of any length is cut into whole windows first; repeated rows are
packed each; a null id is packed like any other; other columns are not read; an empty table gives no rows;
a capacity that is not above ``slack`` is a ValueError.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import text_bytes
from voxelspark.llm.tokens import word_tokenizer
from voxelspark.plans.iterate import bounded_batches

OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Members (places in ``sizes``) of each of ``ways`` nearly equal windows."""
    if not sizes:
        return [[] for _ in range(ways)]
    heap = [(-s, k, [0] * (ways - 1) + [s], [[] for _ in range(ways - 1)] + [[k]]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        both = sorted(((x + y, k) for k, (x, y) in enumerate(zip(a, reversed(b), strict=True))))
        least = both[0][0]
        members = [own[k] + other[ways - 1 - k] for _, k in both]
        sums = [s - least for s, _ in both]  # only differences matter
        heapq.heappush(heap, (-sums[-1], turn, sums, members))
        turn += 1
    return heap[0][3]


def fits(windows: list[list[int]], sizes: list[int], capacity: int) -> bool:
    return all(sum(sizes[k] for k in w) <= capacity for w in windows)


def balanced(sizes: list[int], capacity: int, ways: int = 0) -> list[list[int]]:
    """Windows of at most ``capacity``, ``ways`` or more of them; one more whenever the fullest exceeds it."""
    ways = max(1, ways, -(-sum(sizes) // capacity))
    while not fits(windows := differencing(sizes, ways), sizes, capacity):
        ways += 1
    return [w for w in windows if w]


class Packer:
    """Takes documents in order, gives rows of pieces."""

    def __init__(self, capacity: int, ways: int, piece: int, fine: int, zone: int, slack: int, first: int):
        self.capacity, self.piece, self.fine, self.zone, self.slack, self.next = capacity, piece, fine, zone * ways, slack, first
        self.few, self.ways, self.goal = ways, ways, ways * (capacity - slack)
        self.open: list[tuple] = []  # (doc_id, start, length, ids, doc_tokens)
        self.held = 0

    def _emit(self, members: list[tuple]):
        offset, number, last = 0, self.next, None
        self.next += 1
        for doc, start, length, ids, total in members:
            if last and last[0] is ids and last[2] + last[3] == start:
                last[3] += length
                continue
            if last:
                yield self._row(last, number, offset)
                offset += last[3]
            last = [ids, doc, start, length, total]
        yield self._row(last, number, offset)

    @staticmethod
    def _row(piece, number, offset):
        ids, doc, start, length, total = piece
        return doc, start, length, ids[start * 4 : (start + length) * 4], total, number, offset

    def add(self, doc, ids: bytes):
        total = len(ids) // 4
        whole = total // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield from self._emit([(doc, at, self.capacity, ids, total)])
        at = whole
        while at < total:
            room = self.goal - self.held
            size, room = (self.fine, room) if room <= self.zone else (self.piece, room - self.zone)
            even = -(-(total - at) // -(-(total - at) // size))  # runs of one document are alike, those of different documents differ
            size = min(even, room)
            self.open.append((doc, at, size, ids, total))
            self.held += size
            at += size
            if self.held == self.goal:
                yield from self.close()

    def close(self, last: bool = False):
        sizes = [x[2] for x in self.open]
        more = self.ways < 2 * self.few and not last
        windows = differencing(sizes, self.ways) if more else balanced(sizes, self.capacity, 0 if last else self.ways)
        if not fits(windows, sizes, self.capacity):  # one window more, and runs for it
            self.ways += 1
        else:
            for window in windows:
                if window:
                    yield from self._emit([self.open[k] for k in sorted(window)])
            self.open, self.held, self.ways = [], 0, self.few
        self.goal = self.ways * (self.capacity - self.slack)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, ways: int = 16, piece: int = 512, fine: int = 64, zone: int = 96, slack: int = 20) -> DataFrame:
    """(doc_id, start, length, ids BINARY little-endian unsigned 32-bit, doc_tokens, sequence_id, offset): one row per piece.

    ``slack``: ids that a group leaves free in each window on average, so that nearly equal windows hold the rest.
    """
    if capacity <= slack or min(ways, piece, fine) < 1 or slack < 0:
        raise ValueError("a window holds more than its slack, and ways, piece and fine are 1 at least")
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tool = word_tokenizer(tokenizer)
        packer = Packer(capacity, ways, piece, fine, zone, slack, TaskContext.get().partitionId() << 40)

        def rows(found):
            doc, start, length, ids, total, number, offset = zip(*found, strict=True)
            big = [pa.array(x, pa.int64()) for x in (doc, start, length, total, number, offset)]
            return pa.RecordBatch.from_arrays([*big[:3], pa.array(ids, pa.binary()), *big[3:]], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            ids, body = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 500):
                found = []
                for doc, got in zip(ids[at : at + 500], tool.encode(body.slice(at, 500).to_pylist()), strict=True):
                    found += packer.add(doc, got + end)
                if found:
                    yield rows(found)
        found = list(packer.close(last=True)) if packer.open else []
        if found:
            yield rows(found)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body")).mapInArrow(run, OUT)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, default_tokenizer()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
