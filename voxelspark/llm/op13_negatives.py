"""Hard negatives of anchors by integer inner products, with angular triangle filtering.

Vectors are turned into integers once. Each row stores its norm and its angles to a few reference directions. By the triangle
inequality the angle between two rows lies between the largest difference and the smallest sum of their angles to a reference,
so its cosine lies in an interval; times both norms, widened for rounding and taken to whole numbers, that interval bounds the
score. Only rows whose bounds overlap the window in question are scored, and always in integers:

* positives: rows of the anchor's label whose upper bound reaches the ``positives``-th best of the lower bounds;
* negatives of a positive: rows of other labels whose bounds overlap the window that its score allows, less those whose upper bound
  is under the ``negatives``-th best lower bound among rows that are sure to be inside.

So what is left out cannot be among the rows returned: the result is exact, ties included, whatever the directions are. They are
the first directions, each the one furthest from those before, of a sample of ``sample`` rows at most (those whose ids hash lowest).

Anchors meet all rows in blocks: rows and anchors are dealt into blocks of bounded size by a hash of a row number, and a task
holds one block of each. Neither labels, nor repeated vectors, nor ids decide where a row goes. A block gives at most ``positives``
(``negatives``) rows an anchor (a positive), and Spark's limit of a window keeps that many per task before they are shuffled.

Edge cases: rows with a null label, a null vector or a component that is null or not finite take no part, nor do they as anchors; a
null id takes part as a row with the largest id and is never an anchor; a vector of zeros has score 0 with any; vectors of another
length than the anchor's have no score with it; equal scores go by the smaller id; repeated rows each take part, as positives of each
other too; a row is never its own positive; components whose squares sum to 2**56 or more raise ValueError, as a hundred scores might not fit
64 bits; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.common import partitions
from voxelspark.plans.iterate import Scratch

INDEX = "nth long, vec_id long, label long, is_anchor boolean, q array<long>, norm double, angles array<float>"
POSITIVES = "nth long, positive_id long, positive_score long"
NEGATIVES = "nth long, positive int, negative_id long, negative_score long"
#: What stored angles may be off by, in radians, and a score's bound, as a share of the norms' product and in absolute terms.
ANGLE_OFF, SHARE_OFF, WHOLE_OFF = 2e-6, 1e-12, 1
MOST_PAIRS = 1 << 16
#: Stands for no score; all scores are larger.
NONE = np.int64(-(1 << 62))


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: q has floor(scale * x) of each component."""
    q = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x))
    sound = F.forall(F.col(vector_col).cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("q"))


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector."""
    size = np.diff(column.offsets.to_numpy())
    flat, start = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))
    return [(at, flat[(start[at][:, None] + np.arange(n)).ravel()].reshape(len(at), n)) for n in np.unique(size) for at in [np.flatnonzero(size == n)]]


def directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors of the sample, each the one whose least angle to those before is the largest."""
    norm = np.linalg.norm(sample.astype(float), axis=1)
    unit = sample[norm > 0] / norm[norm > 0, None]
    picked, close = [], np.full(len(unit), -1.0)
    for _ in range(min(count, len(unit))):
        k = int(np.argmin(close))
        if picked and close[k] > 1 - 1e-9:
            break
        picked.append(unit[k])
        close = np.maximum(close, unit @ unit[k])
    return np.array(picked).reshape(len(picked), sample.shape[1])


def build_index(vectors: DataFrame, anchor, count: int = 16, sample: int = 2048) -> DataFrame:
    """The rows of ``quantised`` as a settled table, with number, norm and angles to reference directions. anchor: Column, true for anchors."""
    some = vectors.select("vec_id", "q").orderBy(F.xxhash64("vec_id", "q")).limit(sample).collect()  # bounded by ``sample``
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r["q"]), []).append(r["q"])
    seen = {n: directions(np.array(q, float).reshape(len(q), n), count) for n, q in by_size.items()}

    def run(batches):
        for b in batches:
            angles, norm = np.zeros((b.num_rows, count), np.float32), np.zeros(b.num_rows)
            angles[:] = np.nan  # no direction: no bound but the norms
            for at, q in matrix(b.column("q")):
                x = q.astype(float)
                norm[at] = np.linalg.norm(x, axis=1)
                if (norm[at] >= 2.0**28).any():
                    raise ValueError("components whose squares sum to 2**56 or more: a hundred scores might not fit 64 bits")
                if len(to := seen.get(x.shape[1], ())):
                    cosine = np.divide(x @ to.T, norm[at][:, None], out=np.ones((len(at), len(to))), where=norm[at][:, None] > 0)
                    angles[at[:, None], np.arange(len(to))] = np.arccos(np.clip(cosine, -1, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * count), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("nth", "vec_id", "label", "is_anchor", "q")] + [pa.array(norm), lists], ["nth", "vec_id", "label", "is_anchor", "q", "norm", "angles"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("nth"), "vec_id", "label", F.coalesce(anchor, F.lit(False)).alias("is_anchor"), "q")
    return Scratch(vectors.sparkSession, "angles").settle(numbered.mapInArrow(run, INDEX))


def bounds(a_norm: np.ndarray, a_angles: np.ndarray, norm: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) whole numbers that hold the score of each anchor (row) with each row (column)."""
    there = np.flatnonzero(~np.isnan(a_angles).any(0) & ~np.isnan(angles).any(0)) if len(a_norm) and len(norm) else ()  # rows of one length have the same directions
    shape = (len(a_norm), len(norm))
    low, least, most = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32), np.full(shape, np.pi, np.float32)
    now = np.empty(shape, np.float32)
    for k in there:
        a, x = a_angles[:, k, None], angles[None, :, k]
        np.abs(np.subtract(a, x, out=now), out=now)
        np.maximum(low, now, out=low)
        np.add(a, x, out=now)
        np.minimum(least, now, out=least)
        np.maximum(most, now, out=most)
    high = np.minimum(least, np.float32(2 * np.pi) - most)
    size = a_norm[:, None] * norm[None, :]
    off = WHOLE_OFF + SHARE_OFF * size
    lower = np.cos(np.minimum(high.astype(float) + ANGLE_OFF, np.pi)) * size - off
    upper = np.cos(np.maximum(low.astype(float) - ANGLE_OFF, 0)) * size + off
    return np.floor(lower), np.ceil(upper)


def kth_largest(values: np.ndarray, k: int, none: float = -np.inf) -> np.ndarray:
    """The k-th largest of each row, ``none`` (that also marks what does not count) where there are fewer."""
    out = np.full(len(values), none, values.dtype)
    enough = np.flatnonzero((values > none).sum(1) >= k)
    if len(enough):
        out[enough] = np.partition(values[enough], values.shape[1] - k, axis=1)[:, values.shape[1] - k]
    return out


def scores(a: np.ndarray, x: np.ndarray, wanted: np.ndarray, size: float) -> np.ndarray:
    """Integer inner products where ``wanted``, NONE elsewhere. size: no score is larger.

    Few pairs are scored one by one. Many are a product of the rows that any anchor wants, in doubles while all sums are whole numbers that
    those hold exactly.
    """
    out = np.full(wanted.shape, NONE)
    if size >= 2.0**52 or wanted.mean() < 0.02:
        i, j = np.nonzero(wanted)
        for at in range(0, len(i), MOST_PAIRS):
            p, r = i[at : at + MOST_PAIRS], j[at : at + MOST_PAIRS]
            out[p, r] = np.einsum("ij,ij->i", a[p], x[r])
    else:
        rows = np.flatnonzero(wanted.any(0))
        out[:, rows] = np.where(wanted[:, rows], (a.astype(float) @ x[rows].astype(float).T).astype(np.int64), NONE)
    return out


def first_of(score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``most`` scores of each row: higher ones first, then smaller ids."""
    owner, at = np.nonzero((score > NONE) & (score >= kth_largest(score, most, NONE)[:, None]))
    order = np.lexsort((ids[at], -score[owner, at], owner))
    owner, at = owner[order], at[order]
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    return owner[rank < most], at[rank < most]


class Block:
    """Columns of one block of rows or anchors."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        column = lambda c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        self.table, self.nth, self.label, self.norm = t, t.column("nth").to_numpy(), t.column("label").to_numpy(), t.column("norm").to_numpy()
        self.ids = t.column("vec_id").fill_null((1 << 63) - 1).to_numpy()
        self.angles = column("angles").flatten().to_numpy(zero_copy_only=False).reshape(len(self.nth), -1)
        self.by_size = {q.shape[1]: (at, q) for at, q in matrix(column("q"))}


def pairs_of(a: Block, x: Block):
    """(anchors' places, their vectors, rows' places, their vectors, lower, upper) for each length of vector, some anchors at a time."""
    for n, (i, qa) in a.by_size.items():
        if n in x.by_size:
            j, qx = x.by_size[n]
            step = max(1, (1 << 18) // max(1, len(j)))
            for at in range(0, len(i), step):
                own = i[at : at + step]
                yield own, qa[at : at + step], j, qx, *bounds(a.norm[own], a.angles[own], x.norm[j], x.angles[j])


def nearest_alike(rows: pa.Table, anchors: pa.Table, most: int) -> pa.Table:
    x, a, out = Block(rows), Block(anchors), []
    for i, qa, j, qx, lower, upper in pairs_of(a, x):
        fit = (a.label[i][:, None] == x.label[j][None]) & (a.nth[i][:, None] != x.nth[j][None])
        reach = kth_largest(np.where(fit, lower, -np.inf), most)
        s = scores(qa, qx, fit & (upper >= reach[:, None]), a.norm[i].max() * x.norm[j].max())
        p, r = first_of(s, x.ids[j], most)
        out.append((a.nth[i[p]], x.ids[j[r]], s[p, r]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(cols, names=["nth", "positive_id", "positive_score"])


def hard_unlike(rows: pa.Table, anchors: pa.Table, most: int, low: int, high: int) -> pa.Table:
    x, a, out = Block(rows), Block(anchors), []
    chosen = [np.asarray(p, np.int64) for p in a.table.column("positive_scores").to_pylist()]
    for i, qa, j, qx, lower, upper in pairs_of(a, x):
        other, windows = a.label[i][:, None] != x.label[j][None], []
        wanted = np.zeros(other.shape, bool)
        for turn in range(max((len(chosen[k]) for k in i), default=0)):  # at most ``positives``
            own = np.flatnonzero([len(chosen[k]) > turn for k in i])
            score = np.array([chosen[k][turn] for k in i[own]], np.int64)
            from_, to = (-((-low * score) // 100))[:, None], (high * score // 100)[:, None]  # whole numbers inside the window
            lo, up = lower[own], upper[own]
            sure = other[own] & (lo >= from_) & (up <= to)
            reach = kth_largest(np.where(sure, lo, -np.inf), most)
            wanted[own] |= other[own] & (up >= np.maximum(from_, reach[:, None])) & (lo <= to)
            windows.append((own, from_, to))
        s = scores(qa, qx, wanted, a.norm[i].max() * x.norm[j].max()) if windows else None
        for turn, (own, from_, to) in enumerate(windows):
            inside = np.where((s[own] >= from_) & (s[own] <= to), s[own], NONE)
            p, r = first_of(inside, x.ids[j], most)
            out.append((a.nth[i[own[p]]], np.full(len(p), turn), x.ids[j[r]], inside[p, r]))
    cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table([cols[0], cols[1].astype(np.int32), *cols[2:]], names=["nth", "positive", "negative_id", "negative_score"])


def in_blocks(rows: DataFrame, anchors: DataFrame, fn, schema: str, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """``fn`` on every block of rows with every block of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("nth"), F.lit(n)).cast("int")
    left = rows.select("*", of(row_blocks).alias("_r"), every(anchor_blocks).alias("_a"))
    right = anchors.select("*", every(row_blocks).alias("_r"), of(anchor_blocks).alias("_a"))
    return left.groupBy("_r", "_a").cogroup(right.groupBy("_r", "_a")).applyInArrow(fn, schema)


def hard_negatives(vectors: DataFrame, anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 4096, block_anchors: int = 1024, count: int = 16, sample: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``quantised`` that ``anchor`` (a Column) is true for.

    A negative's score lies between ``low`` and ``high`` per cent of the positive's. Rows and anchors meet in blocks of about
    ``block_rows`` and ``block_anchors``.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, anchor, count, sample)
    n_rows, n_anchors = index.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    row_blocks = max(1, -(-n_rows // block_rows), min(partitions(spark), n_rows // 256))
    anchor_blocks = max(1, -(-n_anchors // block_anchors))
    anchors = index.where("is_anchor")
    order = lambda s, k: (F.col(s).desc(), F.col(k).asc())
    alike = in_blocks(index, anchors, lambda x, a: nearest_alike(x, a, positives), POSITIVES, row_blocks, anchor_blocks)
    best = Window.partitionBy("nth").orderBy(*order("positive_score", "positive_id"))
    chosen = alike.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= positives).groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("_k", "positive_id", "positive_score"))).alias("p"))
    told = Scratch(spark, "chosen").settle(anchors.join(chosen, "nth"))
    unlike = in_blocks(index, told.select(anchors.columns + [F.col("p.positive_score").alias("positive_scores")]), lambda x, a: hard_unlike(x, a, negatives, low, high), NEGATIVES, row_blocks, anchor_blocks)
    best = Window.partitionBy("nth", "positive").orderBy(*order("negative_score", "negative_id"))
    ranked = unlike.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    p = F.element_at("p", F.col("positive") + 1)
    whole = lambda c: F.when(c < (1 << 63) - 1, c)
    return ranked.join(told.select("nth", F.col("vec_id").alias("anchor_id"), "p"), "nth").select("anchor_id", whole(p["positive_id"]).alias("positive_id"), "rank", whole(F.col("negative_id")).alias("negative_id"), p["positive_score"].alias("positive_score"), "negative_score")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
