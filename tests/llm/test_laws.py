"""The law of sharding on repeated rows, and arguments of packing."""

import pytest
from pyspark.sql import functions as F

from voxelspark.llm import op9_packing as T9
from voxelspark.llm import op10_slots as T10
from voxelspark.plans.iterate import Scratch


@pytest.mark.parametrize("ids", [None, 7])
def test_bytes_law_on_repeated_rows(spark, ids):
    one = spark.range(3000).select(F.lit(ids).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"))
    other = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = T10.shard_records(one.unionByName(other).repartition(5), f"{Scratch(spark, 'law').root}/map", part_rows=100).collect()
    load, slots = {}, {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 6000 and sorted(load) == list(range(16))
    assert max(load.values()) - min(load.values()) <= 20  # the largest row
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_later_versions_keep_what_is_dealt_by_row(spark):
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    path = f"{Scratch(spark, 'law').root}/map"
    records = Scratch(spark, "records").settle(T10.measured(rows))
    assert T10.rebalance(records, path) == 2 and T10.rebalance(records, path) == 3
    assert T10.read_map(spark, path, 3)[2] == T10.read_map(spark, path, 2)[2] and [kind for kind, _ in T10.read_map(spark, path)[2]] == ["hot", "same"]


@pytest.mark.parametrize("how", [{"capacity": 16}, {"capacity": 20}, {"ways": 0}, {"piece": 0}])
def test_packing_arguments(spark, how):
    with pytest.raises(ValueError):
        T9.pack_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), T9.default_tokenizer(), **how)
