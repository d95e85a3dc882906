"""Removal of repeated word runs, by fixed-block anchors.

A window is ``window`` consecutive words of one document. A word goes if a window covers it whose words also start in a
document with a smaller doc_id; windows are judged on the input.

1. *Anchors.* Each document is laid out in non-overlapping reference blocks of ``block`` words, where
   ``2 * block - 1 <= window``, so every window holds a whole reference block of any document it repeats. The hashes of the
   blocks are indexed, and the hash of every rolling run of ``block`` words probes that index. Index entries and probes meet
   in parts by hash; a probe whose block is indexed and occurs elsewhere is an anchor.
2. *Extension.* Only windows that hold an anchor can repeat. Their 96-bit hashes over all ``window`` words meet in parts
   again, each part finds the smallest doc_id of every hash, and windows that start in a larger one are hits. Hits one word
   apart join into maximal exact repeats.
3. Repeats are joined back and cut out of the text.

Nothing is paired: a passage with a million copies costs a million entries, spread over as many parts as it has different windows;
all windows of a text that is one word over and over are one, so their entries (14 bytes each) meet in one part. Entries travel as
packed arrays, one row per map batch and part, about six bytes a word. There are ``SPREAD`` parts for each of
``spark.sql.shuffle.partitions``, so a part's size stays the same when that setting grows with the input. Positions are joined to
texts by sort and merge at every size: their files compress so well that Spark would take them for small enough to broadcast.

Edge cases: null or blank text has no words; rows with a null doc_id neither repeat others nor lose words; repeated rows with
one doc_id never repeat each other (no smaller id) and get equal results; extra columns stay in ``row`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import byte_chunks, mixed, partitions, planes, span_hashes, unplanes, word_spans
from voxelspark.plans.iterate import Scratch

#: A second multiplier, for the check part of a window's hash.
CHECK = np.uint64(0xD6E8FEB86659FD93)
#: Parts for each shuffle partition: a task holds one part at a time.
SPREAD = 4
#: Parts that found positions are dealt to by document: rows between parts then grow with the parts, not with their square.
RECEIVERS = 64
PACKED = "part int, n int, payload binary"
SPOTS = "doc_id long, mark long, spots binary"


def words_of(data, start, end):
    """(word hash, first word of each document, word count) of a chunk of documents."""
    ws, we, first = word_spans(data, start, end)
    return span_hashes(data, ws, we), first[:-1], np.diff(first), ws, we


def rolling(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, word) of every run of ``size`` words that lies in one document."""
    runs = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(len(first)), runs)
    word = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    at = first[doc] + word
    return span_hashes(hashes, at, at + size), doc, word


def pack(part: np.ndarray, parts: int, doc: np.ndarray, word: np.ndarray, ids: np.ndarray, marks: np.ndarray, values: list[np.ndarray]):
    """One (part, n, payload) row per part: documents with their entry counts, word positions and values, all in byte places."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        own = order[cut[p] : cut[p + 1]]
        d, w = doc[own], word[own]
        new = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        count = np.diff(np.append(new, len(own))).astype(np.uint32)
        step = np.diff(w, prepend=0)
        step[new] = w[new]
        head = np.diff(ids[d[new]], prepend=0)
        body = [np.uint32(len(new)).tobytes(), planes(head.astype(np.int64)), planes(marks[d[new]].astype(np.uint32)), planes(count), planes(step.astype(np.uint32))]
        yield int(p), len(own), b"".join(body + [planes(v[own]) for v in values])


def unpack(payload: bytes, n: int, kinds: list):
    """(ids, marks, document of each entry, word, values) of one payload."""
    data = memoryview(payload)
    docs, at = int(np.frombuffer(data[:4], np.uint32)[0]), 4
    out = []
    for kind, size in [(np.int64, docs), (np.uint32, docs), (np.uint32, docs), (np.uint32, n), *((k, n) for k in kinds)]:
        out.append(unplanes(data[at:], kind, size))
        at += size * np.dtype(kind).itemsize
    ids, marks, count, step, *values = out
    doc = np.repeat(np.arange(docs), count)
    run = np.cumsum(step, dtype=np.int64)
    before = np.cumsum(count, dtype=np.int64) - count
    base = run[before] - step[before]
    return np.cumsum(ids), marks, doc, run - base[doc], values


def unpack_all(t: pa.Table, kinds: list):
    """Every payload of a part as one: (ids, marks, document, word, values)."""
    ids, marks, doc, word, values, docs = [], [], [], [], [], 0
    for n, payload in zip(t.column("n").to_pylist(), t.column("payload").to_pylist(), strict=True):
        i, m, d, w, v = unpack(payload, n, kinds)
        ids.append(i), marks.append(m), doc.append(d + docs), word.append(w), values.append(v)
        docs += len(i)
    return np.concatenate(ids), np.concatenate(marks), np.concatenate(doc), np.concatenate(word), [np.concatenate(v) for v in zip(*values, strict=True)]


def receivers(parts: int) -> int:
    return min(parts, RECEIVERS)


def deal_out(ids, marks, doc, word, parts: int) -> pa.Table:
    """Found word positions, packed again and dealt by document."""
    part = (mixed(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)[doc]
    got = list(zip(*pack(part, parts, doc, word, ids, marks, []), strict=True)) or [[], [], []]
    return pa.table({"part": pa.array(got[0], pa.int32()), "n": pa.array(got[1], pa.int32()), "payload": pa.array(got[2], pa.binary())})


def gather(t: pa.Table) -> pa.Table:
    """One row (doc_id, mark, spots) per document: its word positions in order, as steps in byte places."""
    ids, marks, doc, word, _ = unpack_all(t, [])
    order = np.lexsort((word, marks[doc], ids[doc]))
    own, mark, word = ids[doc[order]], marks[doc[order]], word[order]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (mark[1:] != mark[:-1])))
    step = np.diff(word, prepend=0)
    step[new] = word[new]
    stop = np.append(new[1:], len(own))
    spots = [planes(step[i:j].astype(np.uint32)) for i, j in zip(new.tolist(), stop.tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(own[new], pa.int64()), "mark": pa.array(mark[new].astype(np.int64), pa.int64()), "spots": pa.array(spots, pa.binary())})


def spots_read(blob: bytes | None) -> np.ndarray:
    return np.cumsum(unplanes(memoryview(blob or b""), np.uint32, len(blob or b"") // 4), dtype=np.int64)


def covered(length: int, spots: np.ndarray, before: int, size: int) -> np.ndarray:
    """True at positions spot - before .. spot - before + size - 1 of any spot, within 0..length-1."""
    edge = np.zeros(length + 1, np.int64)
    low = np.clip(spots - before, 0, length)
    np.add.at(edge, low, 1)
    np.add.at(edge, np.clip(spots - before + size, 0, length), -1)
    return np.cumsum(edge[:-1]) > 0


def map_anchors(parts: int, block: int):
    def run(batches):
        for b in batches:
            ids, marks = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("mark").to_numpy(zero_copy_only=False)
            for row, rows, data, start, end in byte_chunks(b.column("body")):
                h, first, count, _, _ = words_of(data, start, end)
                h, doc, word = rolling(h, first, count, block)
                if not len(h):
                    continue
                # low bits deal; the part keeps 31 more and one bit that tells a reference block
                key = ((h >> np.uint64(33)) << np.uint64(1)).astype(np.uint32) | (word % block == 0).astype(np.uint32)
                got = list(zip(*pack((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts), parts, doc, word, ids[row : row + rows], marks[row : row + rows], [key]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int32()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.binary())], ["part", "n", "payload"])

    return run


def part_anchors(t: pa.Table, parts: int) -> pa.Table:
    ids, marks, doc, word, (key,) = unpack_all(t, [np.uint32])
    probe = key >> np.uint32(1)
    order = np.argsort(probe)
    held = probe[order]
    cut = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    indexed = np.bitwise_or.reduceat(key[order] & np.uint32(1), cut) > 0
    size = np.diff(np.append(cut, len(held)))
    anchor = np.zeros(len(key), bool)
    anchor[order] = np.repeat(indexed & (size > 1), size)
    return deal_out(ids, marks, doc[anchor], word[anchor], parts)


def map_windows(parts: int, window: int, block: int):
    def run(batches):
        for b in batches:
            ids, marks, spots = b.column("doc_id").to_numpy(), b.column("mark").to_numpy(), b.column("spots")
            for row, rows, data, start, end in byte_chunks(b.column("body")):
                h, first, count, _, _ = words_of(data, start, end)
                wh, doc, word = rolling(h, first, count, window)
                runs = np.maximum(count - window + 1, 0)
                at, keep = 0, np.zeros(len(wh), bool)
                for k, n in enumerate(runs.tolist()):
                    if n:  # a window holds an anchor that starts at its word 0 .. window - block
                        keep[at : at + n] = covered(n, spots_read(spots[row + k].as_py()), window - block, window - block + 1)
                    at += n
                if not keep.any():
                    continue
                wh, doc, word = wh[keep], doc[keep], word[keep]
                spot = first[doc] + word
                check = (span_hashes(h * CHECK, spot, spot + window) >> np.uint64(32)).astype(np.uint32)
                got = list(zip(*pack((wh & np.uint64(0xFFFFFFFF)) % np.uint64(parts), parts, doc, word, ids[row : row + rows], marks[row : row + rows], [wh, check]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int32()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.binary())], ["part", "n", "payload"])

    return run


def part_windows(t: pa.Table, parts: int) -> pa.Table:
    ids, marks, doc, word, (h, check) = unpack_all(t, [np.uint64, np.uint32])
    order = np.lexsort((check, h))
    a, c = h[order], check[order]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
    least = np.minimum.reduceat(ids[doc[order]], cut)
    hit = np.zeros(len(h), bool)
    hit[order] = ids[doc[order]] > np.repeat(least, np.diff(np.append(cut, len(a))))
    return deal_out(ids, marks, doc[hit], word[hit], parts)


def cut_out(window: int, body_at: str):
    def run(batches):
        for b in batches:
            row, spots = b.column("row"), b.column("spots")
            out = {"n_words": [], "n_removed": [], "kept": [], "repeats": []}
            for text, found in zip(row.field(body_at).to_pylist(), spots.to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = covered(len(words), spots_read(found), 0, window)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(edge) else words).decode())
                out["repeats"].append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["repeats"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["row", *out],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block: int = 25) -> DataFrame:
    """(row STRUCT of the input's columns, n_words, n_removed, kept STRING, repeats ARRAY<STRUCT<start, end>> in words).

    kept: the words that stay, joined by one space.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole reference block: 2 * block - 1 <= window")
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "substrings"), SPREAD * partitions(spark)
    rows = docs.select(F.struct("*").alias("row"))
    at = F.col("row")[id_col].cast("long")
    body = F.encode(F.col("row")[text_col], "UTF-8")
    mark = F.xxhash64(F.col("row")[text_col]).bitwiseAND(F.lit(0xFFFFFFFF))
    keyed = rows.where(at.isNotNull() & F.col("row")[text_col].isNotNull())
    flat = keyed.select(at.alias("doc_id"), mark.alias("mark"), body.alias("body"))

    def found(packed: DataFrame, part) -> DataFrame:
        to = receivers(parts)
        dealt = packed.groupBy("part").applyInArrow(lambda t: part(t, to), PACKED)
        return scratch.settle(dealt.groupBy("part").applyInArrow(gather, SPOTS))

    anchors = found(flat.mapInArrow(map_anchors(parts, block), PACKED), part_anchors)
    likely = flat.join(anchors.hint("merge"), ["doc_id", "mark"])
    hits = found(likely.mapInArrow(map_windows(parts, window, block), PACKED), part_windows)
    scratch.drop(anchors)

    schema = rows.schema["row"].dataType.simpleString()
    both = rows.select("row", at.alias("doc_id"), mark.alias("mark")).join(hits.hint("merge"), ["doc_id", "mark"], "left").select("row", "spots")
    return both.mapInArrow(cut_out(window, text_col), f"row {schema}, n_words long, n_removed long, kept string, repeats array<struct<start:long,end:long>>")


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
