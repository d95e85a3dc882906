"""Volumes, lookup tables, skeletons and logs as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi
from voxelspark.sources.schema import LUT, POS


def read_volume(spark: SparkSession, path: str, roi: Roi | None = None, schema=None, scale: int = 0) -> DataFrame:
    """A volume's table; the finest scale if it has several; cropped to ``roi`` while it is read."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if "scale" in df.columns:
        df = df.where(F.col("scale") == scale).drop("scale")
    return df if roi is None else df.where(roi.holds())


def write_volume(df: DataFrame, path: str, block: tuple[int, int, int]) -> None:
    """Owned voxels by block; a block that is written again replaces its older self alone."""
    owned = df.where("owned").drop("owned") if "owned" in df.columns else df
    number = F.concat_ws("_", *(F.floor(F.col(a) / b).cast("string") for a, b in zip(POS, block, strict=True)))
    owned.withColumn("block_id", number).repartition("block_id").sortWithinPartitions("block_id", *POS).write.partitionBy("block_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_lut(lut: DataFrame, path: str, run_type: str, merge_function: str) -> None:
    """One table for all thresholds, partitioned by run type, merge function and threshold."""
    named = lut.select(F.lit(run_type).alias("run_type"), F.lit(merge_function).alias("merge_function"), *LUT.names)
    named.write.partitionBy("run_type", "merge_function", "threshold").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_lut(spark: SparkSession, path: str, run_type: str, merge_function: str, threshold: str) -> DataFrame:
    """(fragment, segment) of one threshold; only its folder is read."""
    schema = "fragment long, segment long, run_type string, merge_function string, threshold decimal(6,4)"
    found = spark.read.schema(schema).parquet(path)
    return found.where((F.col("run_type") == run_type) & (F.col("merge_function") == merge_function) & (F.col("threshold") == F.lit(threshold).cast("decimal(6,4)"))).select("fragment", "segment")


def read_skeletons(sites: DataFrame, mask: DataFrame, components: DataFrame, bones: DataFrame, roi: Roi) -> tuple[DataFrame, DataFrame]:
    """(sites, bones): masked sites in the box with their component, and bones with both ends among them."""
    inside = sites.where(roi.holds()).join(mask.select("id", "masked"), "id").where("masked").join(components.select("id", "component_id"), "id")
    for end in ("source", "target"):
        bones = bones.join(inside.select(F.col("id").alias(end)), end, "left_semi")
    return inside, bones


def synaptic_sites(synapses: DataFrame) -> DataFrame:
    return synapses.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by the order of a hash: the same rows at every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def open_blocks(blocks: DataFrame, log: DataFrame) -> DataFrame:
    """Blocks that the log doesn't have as done."""
    return blocks.join(log.select("block_id").distinct(), "block_id", "left_anti")


def strip_prefix(name: str, prefix: str = "edges_"):
    return F.when(F.col(name).startswith(prefix), F.expr(f"substring({name}, {len(prefix) + 1})")).otherwise(F.col(name))
