"""Volumes, graphs and skeletons as views of the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.operators.agglomerate import edge_affinities
from voxelspark.operators.blocks import parts_for
from voxelspark.operators.rag import nodes_of
from voxelspark.operators.voxels import line_before
from voxelspark.plans.iterate import measured_joins

WIDTH = 125


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    measured_joins(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def plane(spark: SparkSession, d: str) -> DataFrame:
    """2-D volume of orders: ground truth cells of 10 x 10 with some background, fragments of 5 x 5, raw values."""
    k = F.col("o_orderkey")
    hole = (F.col("o_orderstatus") == "P") & (k % 7 == 0)
    return table(spark, d, "orders").select(
        F.lit(0).alias("z"), F.floor(k / WIDTH).cast("int").alias("y"), (k % WIDTH).cast("int").alias("x"),
        F.when(hole, 0).otherwise(1 + F.floor(k / 1250) * 13 + F.floor(k % WIDTH / 10)).cast("long").alias("gt"),
        (1 + F.floor(k / 625) * 25 + F.floor(k % WIDTH / 5)).cast("long").alias("frag"), F.col("o_totalprice").alias("raw"),
    )


def height(spark: SparkSession, d: str, name: str = "orders", key: str = "o_orderkey") -> int:
    """Rows of the plane, or of the sparse volume, from file statistics."""
    return (table(spark, d, name).agg(F.max(key)).first()[0] or 0) // WIDTH + 1


def plane_affinities(spark: SparkSession, d: str) -> DataFrame:
    """The plane with the affinity of each voxel to its predecessor in y and x; none in z."""
    p = line_before(line_before(plane(spark, d), "y", "raw", "_y"), "x", "raw", "_x")
    near = lambda c: F.exp(-F.abs(F.col("raw") - F.col(c)) / 100_000)
    return p.select("z", "y", "x", "gt", "frag", "raw", F.lit(None).cast("double").alias("aff_z"), near("_y").alias("aff_y"), near("_x").alias("aff_x"))


def plane_samples(spark: SparkSession, d: str) -> DataFrame:
    return edge_affinities(plane_affinities(spark, d), "frag")


def plane_edges(spark: SparkSession, d: str) -> DataFrame:
    """(u, v, n, merge_score): touching fragments, 1 - mean affinity."""
    return plane_samples(spark, d).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), (1 - F.avg("aff")).alias("merge_score"))


def plane_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes_of(plane(spark, d), "frag")


def block(spark: SparkSession, d: str) -> DataFrame:
    """Sparse 3-D volume of lineitems; a large table is summed in tasks of about as many rows each, whatever the settings."""
    k, lines = F.col("l_orderkey"), table(spark, d, "lineitem")
    if (parts := parts_for(lines, lines.count())) is not None:
        lines = lines.repartition(parts, "l_linenumber", "l_orderkey")
    return lines.groupBy(F.col("l_linenumber").alias("z"), k).agg(F.min("l_suppkey").alias("label"), F.sum("l_extendedprice").alias("raw")).select(
        "z", F.floor(k / WIDTH).cast("int").alias("y"), (k % WIDTH).cast("int").alias("x"), F.col("label").cast("long").alias("label"), "raw"
    )


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Skeleton sites of events: a component per user, placed on the plane; ``value`` is the place along the skeleton."""
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), F.lit(0).alias("z"), F.floor(e / WIDTH).cast("int").alias("y"), (e % WIDTH).cast("int").alias("x"), F.col("user_id").alias("component_id"), (F.col("user_id") % 3 != 0).alias("masked"), "value")


def bones(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive events of a user."""
    from pyspark.sql import Window

    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    both = table(spark, d, "events").select(F.col("user_id").alias("component_id"), F.col("event_id").alias("source"), F.lead("event_id").over(line).alias("target"), F.abs(F.col("value") - F.lead("value").over(line)).alias("length"))
    return both.where("target is not null")


def thirds(nodes: DataFrame, size: int = 3) -> DataFrame:
    """(fragment, segment): every ``size`` fragments in a row are one segment, named by the first."""
    return nodes.select(F.col("id").alias("fragment"), (F.floor((F.col("id") - 1) / size) * size + 1).cast("long").alias("segment"))


V1 = """v1 AS (SELECT 0 AS z, CAST(o_orderkey // 125 AS INT) AS y, CAST(o_orderkey % 125 AS INT) AS x,
 CAST(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN 0 ELSE 1 + (o_orderkey // 1250) * 13 + (o_orderkey % 125) // 10 END AS BIGINT) AS gt,
 CAST(1 + (o_orderkey // 625) * 25 + (o_orderkey % 125) // 5 AS BIGINT) AS frag, o_totalprice AS raw FROM orders)"""
NODES1 = "nodes AS (SELECT frag AS id, avg(z) AS center_z, avg(y) AS center_y, avg(x) AS center_x FROM v1 GROUP BY frag)"
SAMPLES1 = """samples AS (SELECT least(a.frag, b.frag) AS u, greatest(a.frag, b.frag) AS v, exp(-abs(a.raw - b.raw) / 100000) AS aff
 FROM v1 a JOIN v1 b ON a.y = b.y + 1 AND a.x = b.x WHERE a.frag <> b.frag
 UNION ALL SELECT least(a.frag, b.frag), greatest(a.frag, b.frag), exp(-abs(a.raw - b.raw) / 100000)
 FROM v1 a JOIN v1 b ON a.y = b.y AND a.x = b.x + 1 WHERE a.frag <> b.frag)"""
E1 = "e1 AS (SELECT u, v, count(*) AS n, 1 - avg(aff) AS merge_score FROM samples GROUP BY u, v)"
GRAPH1 = f"{V1}, {NODES1}, {SAMPLES1}, {E1}"
V2 = """v2 AS (SELECT l_linenumber AS z, CAST(l_orderkey // 125 AS INT) AS y, CAST(l_orderkey % 125 AS INT) AS x,
 CAST(min(l_suppkey) AS BIGINT) AS label, sum(l_extendedprice) AS raw FROM lineitem GROUP BY l_linenumber, l_orderkey)"""
SITES = """sites AS (SELECT event_id AS id, 0 AS z, CAST(event_id // 125 AS INT) AS y, CAST(event_id % 125 AS INT) AS x, user_id AS component_id,
 user_id % 3 <> 0 AS masked, value FROM events)"""
BONES = """bones AS (SELECT * FROM (SELECT user_id AS component_id, event_id AS source, lead(event_id) OVER w AS target,
 abs(value - lead(value) OVER w) AS length FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE target IS NOT NULL)"""
THIRDS = "lut AS (SELECT id AS fragment, CAST((id - 1) // 3 * 3 + 1 AS BIGINT) AS segment FROM nodes)"
SITE_SEG = """site_lut AS (SELECT s.id, coalesce(v.frag, 0) AS fragment FROM sites s LEFT JOIN v1 v ON s.z = v.z AND s.y = v.y AND s.x = v.x),
 seg AS (SELECT s.id, l.segment FROM site_lut s JOIN lut l ON s.fragment = l.fragment)"""
SKELETON = f"{V1}, {NODES1}, {THIRDS}, {SITES}, {BONES}, {SITE_SEG}"


def drawn_sql(seed: int, *columns: str) -> str:
    """32 bits of the MD5 of columns and seed."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(columns)}, '{seed}')), 1, 8) AS BIGINT)"


def uniform_sql(seed: int, *columns: str) -> str:
    return f"({drawn_sql(seed, *columns)} / 4294967296.0::DOUBLE)"


def roots_sql(edges: str, nodes: str = "SELECT id FROM nodes") -> str:
    """CTEs ``links``, ``reach`` and ``comp(node, root)``: components of (u, v) edges, named by their smallest node."""
    return f"""links AS (SELECT u AS a, v AS b FROM ({edges}) UNION ALL SELECT v, u FROM ({edges})),
 reach AS (SELECT id AS root, id AS node FROM ({nodes}) UNION SELECT reach.root, links.b FROM reach JOIN links ON reach.node = links.a),
 comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""
