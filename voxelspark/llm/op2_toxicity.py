"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the presence of hashed character n-grams in the whole text. Their log-count ratios between the two classes scale
them, and a logistic fit on the scaled features gives the weights; a score is the logistic of their sum.

The fit sees labelled rows only, at most ``max_rows`` of them (expected count; rows are chosen by a hash of doc_id, so the
same rows at every run), and keeps the ``features`` n-grams whose ratio is the most certain. Counts are summed
over the sample's partitions, a slice of the buckets at a time, and only n-grams that are kept reach the driver; the fit itself runs in one task over that bounded sample. Scoring is one pass over all rows, no shuffle.

Edge cases: null and empty text score as a text without n-grams (the bias); labels that are null are left out; if a class has
no labelled row, every score is that of the other (0 with no labels at all); repeated rows are scored each, alike. Ties: of
n-grams as certain as each other the smaller bucket is kept; of an id's labels the larger counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import held_out, table
from voxelspark.llm.ngrams import SIZE, fit_logistic, present, row_sums
from voxelspark.plans.iterate import Scratch

ORDERS = (4, 5, 6)
#: Buckets whose counts one group adds up.
SLICE = 1 << 14


class ToxicityModel:
    """Weights by n-gram bucket, and a bias. Bounded by ``features``."""

    def __init__(self, bucket: np.ndarray, weight: np.ndarray, bias: float, orders=ORDERS):
        self.bucket, self.weight, self.bias, self.orders = bucket, weight, bias, orders

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with a column ``score`` in 0..1; an input column of that name is replaced."""
        spark = docs.sparkSession
        sent = spark.sparkContext.broadcast((self.bucket, self.weight.astype(np.float64), self.bias, self.orders))
        plain = docs.drop("score")
        schema = plain.select(F.struct("*").alias("row"))

        def run(batches):
            bucket, weight, bias, orders = sent.value
            chosen, value = np.zeros(SIZE, bool), np.zeros(SIZE)
            chosen[bucket], value[bucket] = True, weight
            for b in batches:
                row = b.column(0)
                texts = row.field(text_col)
                score = np.zeros(len(row))
                for at in range(0, len(row), 2000):
                    for first, n, text, found in present(texts.slice(at, 2000).to_pylist(), orders, chosen):
                        score[at + first : at + first + n] = row_sums(value[found], text, n)
                yield pa.RecordBatch.from_arrays([row, pa.array(1 / (1 + np.exp(-np.clip(score + bias, -500, 500))))], ["row", "score"])

        return schema.mapInArrow(run, f"row {schema.schema['row'].dataType.simpleString()}, score double").select("row.*", "score")


def fit_toxicity(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, features: int = 1 << 12, orders: tuple[int, ...] = ORDERS, alpha: float = 1.0, l2: float = 1e-3) -> ToxicityModel:
    """Fits on rows of ``docs`` that ``labels`` marks and ``trainable`` (a condition on id_col) lets be learnt from."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    if trainable is not None:
        marked = marked.where(trainable)
    share = marked.agg(F.count(F.lit(1)), F.sum("y")).first()
    constant = lambda label: ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 40.0 if label else -40.0, orders)
    if not share[0] or share[1] in (0, share[0]):
        return constant(share[1])
    rate = min(1.0, max_rows / share[0])
    picked = marked.where((F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 30)) < int(rate * (1 << 30))))
    sample = scratch.settle(docs.select(F.col(id_col), F.col(text_col).alias("body")).join(F.broadcast(picked), id_col).select("body", "y").repartition(8))

    n = np.zeros(2)
    for r in sample.groupBy("y").count().collect():  # one row a class
        n[r["y"]] = r["count"]
    if not n.all():  # no row of one class among the documents that were picked
        scratch.drop(sample)
        return constant(n[1])

    def count(batches):
        total = np.zeros((2, SIZE), np.int32)
        for b in batches:
            y = b.column("y").to_numpy()
            for at in range(0, len(y), 500):
                for first, _, text, bucket in present(b.column("body").slice(at, 500).to_pylist(), orders):
                    for c in (0, 1):
                        total[c] += np.bincount(bucket[y[at + first + text] == c], minlength=SIZE).astype(np.int32)
        for k, at in enumerate(range(0, SIZE, SLICE)):
            no, yes = total[:, at : at + SLICE]
            if no.any() or yes.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (no, yes))], ["slice", "no", "yes"])

    def weigh(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        no, yes = (sum(np.frombuffer(x.as_buffer(), np.int32).astype(np.float64) for x in t.column(c)) for c in ("no", "yes"))
        ratio = np.log(((yes + alpha) / (n[1] + 2 * alpha)) / ((no + alpha) / (n[0] + 2 * alpha)))
        sure = np.abs(ratio) / np.sqrt(1 / (yes + alpha) + 1 / (no + alpha))
        sure[yes + no < 2] = 0
        best = np.argsort(-sure, kind="stable")[:features]
        best = best[sure[best] > 0]
        return pa.table({"bucket": pa.array(key[0].as_py() * SLICE + best, pa.int32()), "ratio": ratio[best], "sure": sure[best]})

    # counts are added slice by slice of the buckets; only what is kept comes to the driver
    weighed = sample.mapInArrow(count, "slice int, no binary, yes binary").groupBy("slice").applyInArrow(weigh, "bucket int, ratio double, sure double")
    kept = scratch.settle(weighed.orderBy(F.col("sure").desc(), "bucket").limit(features))
    chosen = sorted((r["bucket"], r["ratio"]) for r in kept.collect())  # at most ``features`` rows
    bucket, scale = np.array([b for b, _ in chosen], np.int64), np.array([x for _, x in chosen], np.float64)
    sent = spark.sparkContext.broadcast((bucket, scale))

    def fit(batches):
        bucket, scale = sent.value
        place = np.full(SIZE, -1, np.int32)
        place[bucket] = np.arange(len(bucket))
        chosen, rows, feats, ys, n = place >= 0, [], [], [], 0
        for b in batches:
            y = b.column("y").to_numpy()
            ys.append(y)
            for at in range(0, len(y), 500):
                for first, _, text, found in present(b.column("body").slice(at, 500).to_pylist(), orders, chosen):
                    rows.append((n + at + first + text).astype(np.int32))
                    feats.append(place[found])
            n += len(y)
        if n:
            w, bias = fit_logistic(np.concatenate(rows), np.concatenate(feats), scale, np.concatenate(ys).astype(float), l2=l2)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float64).tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    found = sample.coalesce(1).mapInArrow(fit, "w binary, bias double").first()
    sent.destroy()
    scratch.drop(sample, kept)
    return ToxicityModel(bucket, np.frombuffer(found["w"], np.float64), found["bias"], orders)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, trainable=~held_out())
    return model.score(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
