"""Scratch tables and settings of two threads at once."""

import threading

from pyspark.sql import functions as F

from voxelspark.plans.iterate import BATCH_BYTES, CLEAN, Scratch, bounded_batches, lifetime


def test_a_lifetime_ends_its_own_tables_alone(spark):
    kept, inside = [], threading.Event()
    go = threading.Event()

    def other():
        inside.wait(60)
        kept.append(Scratch(spark, "other").settle(spark.range(50)))
        go.set()

    t = threading.Thread(target=other, daemon=True)
    t.start()
    before = Scratch(spark, "before").settle(spark.range(7))
    with lifetime(spark):
        mine = Scratch(spark, "mine").settle(spark.range(10))
        with lifetime(spark):
            inner = Scratch(spark, "inner").settle(spark.range(11))
            assert inner.count() == 11
        inside.set()
        go.wait(60)
        assert mine.count() == 10
    t.join()
    assert kept[0].count() == 50 and before.count() == 7
    for gone in (mine, inner):
        path = spark._jvm.org.apache.hadoop.fs.Path(gone._settled_at)
        assert not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def test_settings_are_as_they_were(spark):
    scratch, was = Scratch(spark, "many"), spark.conf.get(CLEAN, "false")
    out = []
    threads = [threading.Thread(target=lambda k=k: out.append((k, scratch.settle(spark.range(100 + k).repartition(3).groupBy((F.col("id") % 5).alias("g")).count())))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(CLEAN, "false") == was
    assert all(sum(r["count"] for r in df.collect()) == 100 + k for k, df in out) and len({df._settled_at for _, df in out}) == 6


def test_batches_are_bounded_unless_told(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bounded_batches(spark)
    assert int(spark.conf.get(key).rstrip("b")) == BATCH_BYTES
    spark.conf.set(key, "1234567")
    bounded_batches(spark)
    assert spark.conf.get(key).startswith("1234567")
    spark.conf.set(key, str(BATCH_BYTES))
