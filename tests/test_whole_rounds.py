"""Loops that go on until nothing is left."""

import pytest
from pyspark.sql import functions as F

from voxelspark.operators import agglomerate as A
from voxelspark.operators import samples as SM


def test_random_crops_of_a_sparse_mask(spark):
    """About one origin in a hundred passes."""
    v = spark.range(100 * 100).select(F.lit(0).alias("z"), (F.col("id") / 100).cast("int").alias("y"), (F.col("id") % 100).cast("int").alias("x")).withColumn("m", F.expr("y between 40 and 52 and x between 40 and 52"))
    got = SM.random_crops(v, 10, (1, 4, 4), "m", 1.0, 3).collect()
    assert len(got) == 10 and all(40 <= r["lo_y"] <= 49 and 40 <= r["lo_x"] <= 49 and r["share"] == 1 for r in got)
    with pytest.raises(ValueError):
        SM.random_crops(v, 10, (1, 14, 14), "m", 1.0, 3)

def test_descriptor_merging_goes_on_until_no_merge_is_left(spark, monkeypatch):
    """A hub and 53 others: one merge a round."""
    score = lambda now, edges, *_: edges.withColumn("score", -1.0 / F.col("v"))
    monkeypatch.setattr(A, "edge_descriptor_scores", score)
    n = 54
    v = spark.range(1, n + 1).select(F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), F.col("id").alias("label"))
    edges = spark.range(2, n + 1).select(F.lit(1).cast("long").alias("u"), F.col("id").alias("v"))
    with pytest.raises(RuntimeError):
        A.agglomerate_by_descriptors(v, edges, v, (1, 1, 1), max_rounds=1)
    _, lut = A.agglomerate_by_descriptors(v, edges, v, (1, 1, 1))
    assert {(r["fragment"], r["segment"]) for r in lut.collect()} == {(k, 1) for k in range(1, n + 1)}
