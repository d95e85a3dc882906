"""Region graphs as Parquet tables: box and id queries, owned writes, modes, keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.operators.rag import latest, ordered
from voxelspark.sources.schema import AXES, EDGES, NODES

CENTER = [f"center_{a}" for a in AXES]


def nodes_in(nodes: DataFrame, low=(None, None, None), high=(None, None, None)) -> DataFrame:
    """Nodes with their centre in the half-open box; None leaves a side open."""
    for c, a, b in zip(CENTER, low, high, strict=True):
        if a is not None:
            nodes = nodes.where(F.col(c) >= a)
        if b is not None:
            nodes = nodes.where(F.col(c) < b)
    return nodes


def nodes_with(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_semi")


def edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose u is among the nodes; v may lie outside."""
    return edges.join(nodes.select(F.col("id").alias("u")), "u", "left_semi").select(edges.columns)


def sub_rag(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node set; an edge's v outside it is a node without attributes."""
    own = edges_of(edges, nodes)
    loose = own.select(F.col("v").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(loose, allowMissingColumns=True), own


def has_edges(nodes: DataFrame, edges: DataFrame) -> bool:
    return not edges_of(edges, nodes).isEmpty()


def owned_edges(edges: DataFrame, nodes: DataFrame, low, high) -> DataFrame:
    """Edges as u <= v whose u has its centre in the half-open box: each edge has one owner."""
    named = ordered(edges.withColumnsRenamed({"u": "_a", "v": "_b"}), "_a", "_b").select(edges.columns)
    return edges_of(named, nodes_in(nodes.dropna(subset=CENTER), low, high))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of the same key (null keys equal each other)."""
    both = table.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, "_version").drop("_version")


@dataclass
class RagStore:
    """Nodes and edges under one path. Modes: ``r`` refuses writes, ``r+`` appends, ``w`` starts with empty tables."""

    spark: SparkSession
    path: str
    mode: str = "r"

    def __post_init__(self):
        if self.mode not in ("r", "r+", "w"):
            raise ValueError(self.mode)
        if self.mode == "w":
            self.spark.createDataFrame([], NODES).write.mode("overwrite").parquet(f"{self.path}/nodes")
            self.spark.createDataFrame([], EDGES).write.mode("overwrite").parquet(f"{self.path}/edges")

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(NODES).parquet(f"{self.path}/nodes")

    def edges(self) -> DataFrame:
        return self.spark.read.schema(EDGES).parquet(f"{self.path}/edges")

    def _writable(self) -> None:
        if self.mode == "r":
            raise PermissionError("the store is open for reading")

    def write_nodes(self, nodes: DataFrame) -> None:
        """Appends nodes whose id the store doesn't have."""
        self._writable()
        fresh = nodes.select(NODES.names).dropDuplicates(["id"]).join(self.nodes().select("id"), "id", "left_anti")
        fresh.select(NODES.names).write.mode("append").parquet(f"{self.path}/nodes")

    def write_edges(self, edges: DataFrame, low=(None, None, None), high=(None, None, None)) -> None:
        """Appends the edges that the box owns and the store doesn't have."""
        self._writable()
        own = owned_edges(edges.select(EDGES.names), self.nodes(), low, high).dropDuplicates(["u", "v"])
        own.join(self.edges().select("u", "v"), ["u", "v"], "left_anti").select(EDGES.names).write.mode("append").parquet(f"{self.path}/edges")

    def read(self, low=(None, None, None), high=(None, None, None)) -> tuple[DataFrame, DataFrame]:
        return sub_rag(nodes_in(self.nodes(), low, high), self.edges())

    def read_ids(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        return sub_rag(nodes_with(self.nodes(), ids), self.edges())
