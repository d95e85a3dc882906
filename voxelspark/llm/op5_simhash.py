"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are 64 bits over word shingles. Two texts link when their fingerprints differ in at most ``radius`` bits, and a
document's component is the smallest doc_id that links reach.

Search: 64 bits fall into ``radius + 1`` segments, so linked fingerprints agree on one whole segment. Every distinct
fingerprint goes, once per segment, to the part that its segment value is dealt to; each part sorts its fingerprints by the
rank of their bits in Gray order (the segment rotated to the top), so that neighbours share long bit patterns. Runs of
neighbours form leaves, runs of leaves form upper nodes; a node keeps the bits on which all below it agree and which its
parent has not settled. A query walks down adding up the differences on those bits and leaves a whole group as soon as the sum
passes the radius. A part returns a star per local component, never pairs, so a group of copies costs its size. Nothing is
capped: every link is found. Stars then meet in ``connected_components``.

Edge cases: null, empty or blank text has fingerprint zero and links like any other; repeated rows give repeated rows; a null
doc_id gets the component of its text (null if no row with an id is reachable).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import partitions, text_bytes
from voxelspark.plans.iterate import Scratch, connected_components

WIDTH = 64
#: Members of a leaf, and children of an upper node.
FAN = 8
#: (query, node) pairs looked at together.
FRONT = 1 << 20


def simhash(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one text: bit i is 1 if set in over half of the shingles' XXH64."""
    words = text.lower().split()  # bytes: ASCII only, both
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k, digest = words_per_shingle - 1, xxhash.xxh64_intdigest
    ones, n = np.zeros(WIDTH, np.int64), len(words) - k
    for at in range(0, n, 1 << 15):
        spans = zip(start[at : min(n, at + (1 << 15))].tolist(), end[at + k : k + min(n, at + (1 << 15))].tolist(), strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in spans], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint BIGINT: the 64 bits as a signed number) for every row."""

    def run(batches):
        for b in batches:
            prints = np.array([simhash(x, words_per_shingle) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body")).mapInArrow(run, "doc_id long, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a codeword in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class GrayIndex:
    """Hierarchical index of one part's fingerprints; roots are the groups that agree on the part's segment."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        """prints: sorted by (group, Gray rank)."""
        self.prints, n = prints, len(prints)
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        edges = [np.arange(n + 1), np.append(cut, n)]  # boundaries of each level's nodes, by member; the last are the roots
        longest = int(np.diff(edges[-1]).max(initial=0))
        size, levels = FAN, []
        while size < longest:
            step = np.concatenate([np.arange(a, b, size) for a, b in zip(edges[-1][:-1], edges[-1][1:], strict=True)])
            levels.append(np.append(step, n))
            size *= FAN
        self.levels = [edges[0], *levels, edges[-1]]  # bottom to top
        self.mask, self.pattern, self.child = [], [], []
        ones = np.uint64((1 << WIDTH) - 1)
        for at in self.levels:
            low = at[:-1]
            both, some = np.bitwise_and.reduceat(prints, low), np.bitwise_or.reduceat(prints, low)
            self.mask.append(~(both ^ some) & ones)
            self.pattern.append(both)
        for k in range(1, len(self.levels)):
            self.child.append(np.searchsorted(self.levels[k - 1], self.levels[k]))
        for k in range(len(self.levels) - 1):  # what the parent has settled is not compared again
            parent = np.repeat(np.arange(len(self.levels[k + 1]) - 1), np.diff(self.child[k]))
            self.mask[k] = self.mask[k] & ~self.mask[k + 1][parent]

    def pairs(self, radius: int):
        """Arrays (i, j), i < j, of members that differ in at most radius bits, in blocks."""
        top = len(self.levels) - 1
        root = np.searchsorted(self.levels[-1], np.arange(len(self.prints)), "right") - 1
        alone = np.diff(self.levels[-1])[root] < 2
        work = [(top, np.flatnonzero(~alone), root[~alone], np.zeros(int((~alone).sum()), np.uint8))]
        while work:
            level, q, node, seen = work.pop()
            if len(q) > FRONT:
                half = len(q) // 2
                work += [(level, q[half:], node[half:], seen[half:]), (level, q[:half], node[:half], seen[:half])]
                continue
            far = seen + np.bitwise_count((self.prints[q] ^ self.pattern[level][node]) & self.mask[level][node])
            ok = (far <= radius) & (self.levels[level][node + 1] - 1 > q) if level else (far <= radius) & (node > q)
            q, node, far = q[ok], node[ok], far[ok]
            if not level:
                if len(q):
                    yield q, node
                continue
            first, count = self.child[level - 1][node], np.diff(self.child[level - 1])[node]
            if len(q):
                for a in range(0, len(q), FRONT // FAN):  # keep what one step opens small
                    b = slice(a, a + FRONT // FAN)
                    c = count[b]
                    step = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                    work.append((level - 1, np.repeat(q[b], c), np.repeat(first[b], c) + step, np.repeat(far[b], c)))


def components(n: int, pairs) -> np.ndarray:
    """Smallest member index reachable, for members 0..n-1; pairs come in blocks and only a star of each block is kept."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def linked(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Star edges (a, b), both doc_ids of representatives, that join all fingerprints within ``radius`` bits.

    prints: (rep LONG, fingerprint LONG), one row per distinct fingerprint. Rows out are at most segments times rows in.
    """
    spark, segments = prints.sparkSession, radius + 1
    cuts = [round(i * WIDTH / segments) for i in range(segments + 1)]
    parts = partitions(spark) * 2

    def part(i: int):  # top bits of the fingerprint rotated so that segment i comes first
        rotated = F.shiftleft("fingerprint", cuts[i]).bitwiseOR(F.shiftrightunsigned("fingerprint", WIDTH - cuts[i])) if i else F.col("fingerprint")
        return F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(rotated, WIDTH - (cuts[i + 1] - cuts[i])).alias("value"))

    def run(t: pa.Table) -> pa.Table:
        segment, prints, rep = (t.column(c).to_numpy() for c in ("segment", "fingerprint", "rep"))
        prints, turn = prints.view(np.uint64), np.array(cuts, np.uint64)[segment]
        rotated = np.where(turn == 0, prints, (prints << turn) | (prints >> ((np.uint64(WIDTH) - turn) & np.uint64(63))))
        value = t.column("value").to_numpy()
        order = np.lexsort((gray_rank(rotated), value, segment))
        group = segment[order].astype(np.int64) * (1 << 40) + value[order]
        label = components(len(order), GrayIndex(rotated[order], group).pairs(radius)) if len(order) else order
        own = np.arange(len(order)) != label
        rep = rep[order]
        return pa.table({"a": pa.array(rep[own]), "b": pa.array(rep[label[own]])})

    dealt = prints.select("rep", "fingerprint", F.explode(F.array(*(part(i) for i in range(segments)))).alias("s")).select("rep", "fingerprint", "s.segment", "s.value")
    return dealt.withColumn("part", F.pmod(F.xxhash64("segment", "value"), F.lit(parts))).groupBy("part").applyInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint LONG, component_id) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.settle(fingerprints(docs, id_col, text_col, words_per_shingle))
    reps = scratch.settle(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    found = connected_components(linked(reps, radius))
    group = reps.join(found.withColumnsRenamed({"node": "rep", "component": "other"}), "rep", "left").select("fingerprint", F.coalesce("other", "rep").alias("component_id"))
    return prints.join(scratch.settle(group), "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
