"""Round loops over DataFrames: where tables are kept between rounds, and connected components.

Every table that outlives a round is written to the folder that the cluster names in ``spark.checkpoint.dir``, so a lost
executor never takes the only copy with it. Only where that setting is absent and the master is local (tests, a laptop) is a
folder made here.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="voxelspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of an Arrow batch that goes to a Python worker: rows of long texts or arrays come in smaller batches than Spark's count of rows.
BATCH_BYTES = 8 << 20
#: How many times its file's bytes a table may take: tables of ids and positions compress that well, and Spark takes a file's bytes for
#: the table's where it decides whether to send the table to the driver and to every task.
UNPACKED = 32
#: Folders made in the ``lifetime`` around, if there is one in this thread.
MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python workers are bounded by bytes too, unless the session says how."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def measured_joins(spark: SparkSession) -> None:
    """Only tables that are small as rows, not as files, are broadcast, unless the session says how; joins that are left open by that
    are decided by what was shuffled."""
    key = "spark.sql.sources.fileCompressionFactor"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(UNPACKED))


class Cleaned:
    """Shuffle files of the writes under way go when a write ends: the setting holds while any is under way, in whatever thread."""

    lock, open, before = threading.Lock(), 0, "false"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        with Cleaned.lock:
            if not Cleaned.open:
                Cleaned.before = self.spark.conf.get(CLEAN, "false")
                self.spark.conf.set(CLEAN, "true")
            Cleaned.open += 1

    def __exit__(self, *_):
        with Cleaned.lock:
            Cleaned.open -= 1
            if not Cleaned.open:
                self.spark.conf.set(CLEAN, Cleaned.before)


class Scratch:
    """Parquet tables in the shared folder that one operator keeps between its jobs.

    ``settle`` writes a frame and reads it back, which cuts its lineage; ``drop`` removes tables that no later job reads. Tables
    that a lazy result still reads stay until the ``lifetime`` around them ends, or as long as the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.lock = 0, threading.Lock()
        bounded_batches(spark)
        measured_joins(spark)
        if (made := MADE.get()) is not None:
            made.append(self.root)

    def settle(self, df: DataFrame) -> DataFrame:
        with self.lock:
            self.n += 1
            path = f"{self.root}/{self.n}"
        with Cleaned(self.spark):  # nothing reads this job's shuffles again
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._settled_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df._settled_at)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def lifetime(spark: SparkSession):
    """Scratch tables that this thread makes inside are deleted at the end: what is needed of lazy results has to be written by then.

    Other threads' tables, also of threads that are started inside, are theirs to keep.
    """
    made: list[str] = []
    token = MADE.set(made)
    try:
        yield
    finally:
        MADE.reset(token)
        for path in made:
            delete(spark, path)


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of a bounded list of edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, whole: int = 0) -> DataFrame:
    """(node, component): the smallest node id reachable over ``edges``; nodes without an edge to another are absent.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). The edge count never grows past the first round's, a
    round is two aggregates and two joins, and rounds grow with the logarithm of the longest path. Null endpoints and self
    edges are ignored. Raises RuntimeError if ``max_rounds`` are not enough. A graph of at most ``whole`` edges, a bounded group, is
    done in one pass instead; the result is the same.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def distinct_edges(df: DataFrame) -> DataFrame:
        return df.where("u <> v").distinct()

    def state(df: DataFrame):
        # edges are (u, v) with u > v; at the fixed point each u has one edge, to its component
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()

    now = scratch.settle(distinct_edges(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())))
    was = state(now)
    if was[0] <= whole:

        def pass_(t: pa.Table) -> pa.Table:
            node, component = local_components(t.column("u").to_numpy(), t.column("v").to_numpy())
            return pa.table({"node": node, "component": component})

        return scratch.settle(now.select(F.col("u").cast("long"), F.col("v").cast("long")).groupBy().applyInArrow(pass_, "node long, component long"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = distinct_edges(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = scratch.settle(distinct_edges(small))
        scratch.drop(now)
        now, is_ = after, state(after)
        if is_ == was:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        was = is_
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
