"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the stated query set; documents are searched whole against it, in blocks of ``items_per_block`` items, so
that what is sent to the tasks stays bounded. The latent space is one for all blocks.

1. Documents are cut into runs of ``stride`` words; a passage is two runs next to each other. Words are lower-case letters
   and digits; the vocabulary is the benchmark's, as no other word changes a cosine with an item. One pass over the texts
   keeps each run's vocabulary words; run frequencies over all documents give the inverse frequencies. Words of more than
   ``common`` of all runs weigh nothing, but an item's ``least`` rarest words always count, however often it was copied.
2. A randomised SVD of the TF-IDF matrix (all runs by vocabulary): two distributed products with the matrix and its transpose,
   orthonormalised between them on the driver, where only vocabulary-by-``rank`` matrices arrive; tasks' parts of them are added
   up a tree.
3. Passages, their first runs and items are folded into the latent space; a passage is a candidate for an item if either's
   cosine with it is ``cosine`` or more. There is no cap.
   What the latent space represents badly comes in by words: of an item's rarest words, some ``overlap`` leaves no room to miss
   (``rare_words``), so every passage that step 4 can accept has at least that many of them around it, and is a candidate too.
4. Candidates that hold enough of the item's words in any order are read word by word: the longest common subsequence with the item, over the passage and an item's length to
   either side, must cover ``overlap`` of the item, and that with the item's answer (its last sentence) ``answer_overlap`` of it.

Edge cases: null or empty texts and texts without vocabulary words leak nothing; items without words match nothing; repeated
rows are searched each; an empty benchmark or document table gives no leaks; extra columns stay in ``row``. Ties: all accepted items
are listed; of an item's passages with the largest share the first is given.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import byte_chunks, planes, span_hashes, table, unplanes, word_spans
from voxelspark.plans.iterate import Scratch

#: Bytes between words, and lower case.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LEAKS = "array<struct<item_id:long,word:long,cosine:double,lcs:double,answer:double>>"
#: Bytes of a slice that a vocabulary-by-rank matrix is summed in, partial sums that one group adds, and vocabulary words that a
#: product takes at once.
SLICE, FAN_IN, STEP = 1 << 20, 32, 1 << 17


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(hash, first word of each text, byte spans) of a chunk's words."""
    low = LOWER[data]
    ws, we, first = word_spans(low, start, end, BETWEEN)
    return span_hashes(low, ws, we), first, ws, we


def hashes_of_texts(texts: list) -> list[np.ndarray]:
    out = []
    for _, rows, data, start, end in byte_chunks(pa.array([(t or "").encode() for t in texts], pa.binary())):
        h, first, _, _ = hashes_of(data, start, end)
        out += [h[first[k] : first[k + 1]] for k in range(rows)]
    return out


def answer_words(text: str, words: np.ndarray) -> np.ndarray:
    """Words of the last sentence; of the last third if there is but one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text or "") if re.search(r"\w", p)]
    n = len(hashes_of_texts([parts[-1]])[0]) if len(parts) > 1 else max(1, len(words) // 3)
    return words[len(words) - n :] if len(words) else words


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    place: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = place.get(x)
        if hit:
            u = row & hit
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Vocabulary:
    """Hashes of the benchmark's words, sorted, with a bitmap in front."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, term) of the words that are in the vocabulary."""
        at = np.flatnonzero(self.near[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.hashes):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[term] == h[at]
        return at[ok], term[ok]


def run_terms(h: np.ndarray, first: np.ndarray, stride: int, vocabulary: Vocabulary):
    """(run, term) of vocabulary words, and each text's first run (n + 1 entries)."""
    runs = np.maximum(1, -(-np.diff(first) // stride))
    start = np.append(0, np.cumsum(runs))
    at, term = vocabulary.find(h)
    doc = np.searchsorted(first, at, "right") - 1
    return start[doc] + (at - first[doc]) // stride, term, start


def fold(run: np.ndarray, term: np.ndarray, runs: int, basis: np.ndarray) -> np.ndarray:
    """Sum of the basis rows of each run's terms; ``run`` is sorted."""
    out = np.zeros((runs, basis.shape[1]), np.float32)
    for a in range(0, len(run), STEP):
        r, t = run[a : a + STEP], term[a : a + STEP]
        cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[cut]] += np.add.reduceat(basis[t], cut, axis=0)
    return out


def back(run: np.ndarray, term: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """Sum over a term's occurrences of its runs' rows: the transposed product."""
    out = np.zeros((terms, y.shape[1]), np.float64)
    for a in range(0, len(run), STEP):
        order = np.argsort(term[a : a + STEP], kind="stable")
        r, t = run[a : a + STEP][order], term[a : a + STEP][order]
        cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        out[t[cut]] += np.add.reduceat(y[r], cut, axis=0)
    return out


def encoded(docs: DataFrame, text_col: str, vocabulary, stride: int) -> DataFrame:
    """(n, runs, payload): packed (run, term) lists of chunks of documents."""

    def go(batches):
        v = vocabulary.value
        for b in batches:
            for _, _, data, start, end in byte_chunks(b.column(0)):
                h, first, _, _ = hashes_of(data, start, end)
                run, term, runs = run_terms(h, first, stride, v)
                payload = planes(np.diff(run, prepend=0).astype(np.uint32)) + planes(term.astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([len(run)], pa.int64()), pa.array([int(runs[-1])], pa.int64()), pa.array([payload], pa.binary())], ["n", "runs", "payload"])

    return docs.select(F.encode(F.col(text_col), "UTF-8")).mapInArrow(go, "n long, runs long, payload binary")


def decoded(batches):
    for b in batches:
        for n, runs, payload in zip(*(b.column(c) for c in ("n", "runs", "payload")), strict=True):
            n, data = n.as_py(), memoryview(payload.as_buffer())
            yield np.cumsum(unplanes(data, np.uint32, n), dtype=np.int64), unplanes(data[4 * n :], np.uint32, n).astype(np.int64), runs.as_py()


def summed(kept: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of vocabulary-sized matrices, added slice by slice up a tree: a group holds FAN_IN parts of one slice,
    whatever the number of tasks or the size of the vocabulary. Slices that a task did not touch are not sent."""
    step = max(1, SLICE // (8 * shape[1]))
    schema = "slice int, task int, part binary"

    def go(batches):
        total = partial(batches)
        if total is not None:
            cut = [(k, total[a : a + step]) for k, a in enumerate(range(0, shape[0], step))]
            cut = [(k, x.astype(np.float64).tobytes()) for k, x in cut if x.any()]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([task] * len(cut), pa.int32()), pa.array([x for _, x in cut], pa.binary())], ["slice", "task", "part"])

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("part"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    parts, tasks = kept.mapInArrow(go, schema), kept.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.groupBy("slice", F.floor(F.col("task") / FAN_IN).cast("int")).applyInArrow(add, schema)
    out = np.zeros(shape)
    for r in parts.collect():  # the vocabulary by the rank, once
        own = out[r["slice"] * step : (r["slice"] + 1) * step]
        own += np.frombuffer(r["part"], np.float64).reshape(own.shape)
    return out


def latent_basis(kept: DataFrame, terms: int, items, rank: int, common: float, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight by term, basis: terms by rank, runs by term) from all encoded runs; items: each one's terms, for one pass."""
    spark = kept.sparkSession

    def count(batches):
        total = np.zeros((terms, 2))
        for run, term, runs in decoded(batches):
            key = np.unique(run * terms + term)
            total[:, 0] += np.bincount(key % terms, minlength=terms)
            total[0, 1] += runs
        return total

    seen = summed(kept, count, (terms, 2))
    idf = np.log((1 + seen[0, 1]) / (1 + seen[:, 0])) + 1
    counts = seen[:, 0] <= common * seen[0, 1]
    for t in items:
        own = np.unique(t)
        counts[own[np.argsort(seen[own, 0], kind="stable")[:least]]] = True
    idf[~counts] = 0

    def product(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast((idf[:, None] * q).astype(np.float32))

        def go(batches):
            weighted, total = sent.value, np.zeros(q_shape)
            for run, term, runs in decoded(batches):
                own = counts[term]
                run, term = run[own], term[own]
                total += back(run, term, fold(run, term, runs, weighted), q_shape[0])
            return total

        q_shape = q.shape
        return summed(kept, go, q.shape) * idf[:, None]

    width = min(terms, rank + 8)
    start = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    q = np.linalg.qr(product(start))[0]
    gram = q.T @ product(q)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    best = np.argsort(-value)[: min(rank, width)]
    return idf, (q @ vector[:, best]), seen[:, 0]


def rare_words(words: list[np.ndarray], seen: np.ndarray, counts: np.ndarray, overlap: float):
    """Each item's rarest words by term: (first place of each term, item, times it stands in the item), and each item's least hits.

    words: each item's terms; seen: runs that hold a term; counts: terms with weight. An item of ``size`` words may miss
    ``size - overlap * size`` of them, so of any T of its words all but that many are there. T goes up to all words with weight,
    and at least to 15 % of the item more than it may miss.
    """
    term, item, times, least = [], [], [], np.zeros(len(words), np.int64)
    for i, t in enumerate(words):
        if not len(t):
            continue
        own, n = np.unique(t, return_counts=True)
        order = np.argsort(seen[own], kind="stable")
        own, n = own[order], n[order]
        total, miss = np.cumsum(n), len(t) - int(np.ceil(overlap * len(t) - 1e-9))
        enough = int(np.searchsorted(total, min(len(t), miss + max(1, round(0.15 * len(t)))))) + 1
        rare = int(np.flatnonzero(counts[own])[-1]) + 1 if counts[own].any() else 0
        take = max(enough, rare)
        term.append(own[:take])
        item.append(np.full(take, i))
        times.append(n[:take])
        least[i] = total[take - 1] - miss
    term, item, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, item, times))
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(len(seen) + 1)), item[order], times[order], least


def by_rare_words(run: np.ndarray, term: np.ndarray, runs: np.ndarray, rare, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) with the item's least hits of rare words in the passage's runs and ``reach`` runs to either side, in its text."""
    (place, item, times, least), total = rare, int(runs[-1])
    count = place[term + 1] - place[term]
    at = np.repeat(place[term] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
    key = item[at] * total + np.repeat(run, count)
    # a word that stands in a run twice counts twice: more candidates, never fewer
    key, where = np.unique(key, return_inverse=True)
    hits = np.append(0, np.cumsum(np.bincount(where, times[at], len(key)))) if len(key) else np.zeros(1)
    i, r = np.divmod(key, total)
    doc = np.searchsorted(runs, r, "right") - 1

    def within(i, low, high):
        return hits[np.searchsorted(key, i * total + high)] - hits[np.searchsorted(key, i * total + low)]

    ok = within(i, r, np.minimum(runs[doc + 1], r + 2 * reach[i] + 2)) >= least[i]  # the first hit of a window opens it
    i, r, doc = i[ok], r[ok], doc[ok]
    low, high = np.maximum(runs[doc], r - 1 - reach[i]), np.minimum(runs[doc + 1], r + reach[i] + 1)
    n = high - low
    p = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum())) if len(n) else low
    i, p = np.divmod(np.unique(np.repeat(i, n) * total + p), total)
    doc = np.searchsorted(runs, p, "right") - 1
    ok = within(i, np.maximum(runs[doc], p - reach[i]), np.minimum(runs[doc + 1], p + 2 + reach[i])) >= least[i]
    return p[ok], i[ok]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = 96, stride: int = 24, cosine: float = 0.5, common: float = 0.003, least: int = 8, overlap: float = 0.75, answer_overlap: float = 0.75, items_per_block: int = 5000, seed: int = 7) -> DataFrame:
    """(row STRUCT of the document's columns, leaks ARRAY of the items it holds: item_id, first word of the passage, cosine,
    share of the item and of its answer that follow each other there)."""
    spark = docs.sparkSession
    out = docs.select(F.struct("*").alias("row"), F.lit(None).cast(LEAKS).alias("leaks"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    blocks = max(1, -(-items.count() // items_per_block))

    def part(block: int) -> tuple[list, list, list]:
        """(ids, words, answers) of about items_per_block items."""
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        words = hashes_of_texts([r["text"] for r in rows])
        return [r["item"] for r in rows], words, [answer_words(r["text"], w) for r, w in zip(rows, words, strict=True)]

    only = part(0) if blocks == 1 else None
    vocabulary = Vocabulary(np.unique(np.concatenate([np.unique(np.concatenate([np.zeros(0, np.uint64), *(only or part(k))[1]])) for k in range(blocks)])))
    if not len(vocabulary.hashes):
        return out
    # one latent space, of all items' words, whatever the number of blocks
    tool, scratch = spark.sparkContext.broadcast(vocabulary), Scratch(spark, "semantic")
    kept = scratch.settle(encoded(docs.select(text_col), text_col, tool, stride))
    terms = (vocabulary.find(w)[1] for k in range(blocks) for w in (only or part(k))[1])
    space = latent_basis(kept, len(vocabulary.hashes), terms, rank, common, least, seed)
    scratch.drop(kept)
    for block in range(blocks):
        out = _search(spark, out, only or part(block), vocabulary, tool, space, text_col, stride, cosine, overlap, answer_overlap)
    return out


def _search(spark, rows: DataFrame, items: tuple[list, list, list], vocabulary: Vocabulary, tool, space, text_col, stride, cosine, overlap, answer_overlap) -> DataFrame:
    (ids, words, answers), (idf, basis, seen) = items, space
    if not any(map(len, words)):
        return rows
    longest = max(map(len, words))
    folded = (idf[:, None] * basis).astype(np.float32)
    aim = unit(np.stack([folded[vocabulary.find(w)[1]].sum(axis=0) if len(w) else np.zeros(folded.shape[1]) for w in words])).astype(np.float32)
    rare = rare_words([vocabulary.find(w)[1] for w in words], seen, idf > 0, overlap)
    reach = np.array([-(-len(w) // stride) for w in words])
    sent = spark.sparkContext.broadcast((folded, aim, words, answers, ids, idf > 0, rare, reach))

    def go(batches):
        v, (folded, aim, words, answers, ids, counts, rare, reach) = tool.value, sent.value
        listed, distinct = [w.tolist() for w in words], [set(w.tolist()) for w in words]
        for b in batches:
            row, had = b.column("row"), b.column("leaks")
            found: dict[int, dict] = {}
            for at, _, data, start, end in byte_chunks(row.field(text_col)):
                h, first, _, _ = hashes_of(data, start, end)
                run, term, runs = run_terms(h, first, stride, v)
                own = counts[term]
                y = fold(run[own], term[own], int(runs[-1]), folded)
                last = np.zeros(len(y), bool)
                last[runs[1:] - 1] = True
                both = y.copy()
                both[:-1][~last[:-1]] += y[1:][~last[:-1]]  # a passage: a run and the next of its text
                alone, pair = (1 / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (y, both))
                found_at, found_cos = [], []
                for a in range(0, len(y), 1 << 13):
                    z = min(len(y), a + (1 << 13))
                    raw = y[a : z + 1] @ aim.T  # a passage's products are the sums of its runs'
                    ahead = np.flatnonzero(~last[a:z])
                    close = raw[: z - a] * alone[a:z]
                    two = raw[: z - a].copy()
                    two[ahead] += raw[ahead + 1]
                    np.maximum(close, two * pair[a:z], out=close)
                    near, item = np.nonzero(close >= cosine)
                    found_at.append((near + a) * len(words) + item)
                    found_cos.append(close[near, item])
                near, item = by_rare_words(run, term, runs, rare, reach)
                for k in range(0, len(near), 1 << 13):
                    p, i = near[k : k + (1 << 13)], item[k : k + (1 << 13)]
                    found_at.append(p * len(words) + i)
                    found_cos.append(np.maximum((y[p] * aim[i]).sum(axis=1) * alone[p, 0], (both[p] * aim[i]).sum(axis=1) * pair[p, 0]))
                keys, where = np.unique(np.concatenate(found_at) if found_at else np.zeros(0, np.int64), return_index=True)
                cosines = np.concatenate(found_cos)[where] if found_cos else where
                near, item = np.divmod(keys, len(words))
                docs_of = np.searchsorted(runs, near, "right") - 1
                held, here = -1, set()
                for p, i, doc, cos in zip(near.tolist(), item.tolist(), docs_of.tolist(), cosines.tolist(), strict=True):
                    size = len(words[i])
                    low, high, word = int(first[doc]), int(first[doc + 1]), (p - int(runs[doc])) * stride
                    if held != p:  # room for the longest item
                        held, here = p, set(h[max(low, low + word - longest) : min(high, low + word + 2 * stride + longest)].tolist())
                    # a missing word costs the item one place at least
                    if len(distinct[i] & here) < len(distinct[i]) - (1 - overlap) * size or sum(x in here for x in listed[i]) < overlap * size:
                        continue
                    text = h[max(low, low + word - size) : min(high, low + word + 2 * stride + size)]
                    share = common_length(words[i], text) / size
                    if share < overlap:
                        continue
                    answer = common_length(answers[i], text) / len(answers[i])
                    best = found.setdefault(at + doc, {})
                    if answer >= answer_overlap and share > best.get(i, {"lcs": 0})["lcs"]:
                        best[i] = {"item_id": ids[i], "word": word, "cosine": cos, "lcs": share, "answer": answer}
            leaks = had.to_pylist()
            for k, best in found.items():
                if best:
                    leaks[k] = (leaks[k] or []) + [best[i] for i in sorted(best)]
            yield pa.RecordBatch.from_arrays([row, pa.array(leaks, LEAKS_ARROW)], ["row", "leaks"])

    return rows.mapInArrow(go, f"row {rows.schema['row'].dataType.simpleString()}, leaks {LEAKS}")


LEAKS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("word", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))


def op6_semantic(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return find_leaks(docs, benchmark).select(F.col("row.doc_id").alias("doc_id"), F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
