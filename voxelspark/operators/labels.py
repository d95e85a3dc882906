"""Label statistics: centres, boxes, sizes, renumbering, components of voxels and boundary growth."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.operators.blocks import components_in_blocks
from voxelspark.operators.voxels import FACES, HALF_2, neighbours
from voxelspark.plans.iterate import Scratch, connected_components
from voxelspark.sources.schema import AXES, POS


def centers(voxels: DataFrame, label: str = "label", offset=(0, 0, 0), voxel_size=(1, 1, 1)) -> DataFrame:
    """(id, center_z, center_y, center_x) in world units of each label but 0."""
    return voxels.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(*((F.avg(a) * s + o).alias(f"center_{a}") for a, o, s in zip(AXES, offset, voxel_size, strict=True)))


def bounding_boxes(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))))


def means(voxels: DataFrame, value: str, label: str = "label") -> DataFrame:
    return voxels.where(F.col(label) != 0).groupBy(F.col(label).alias("id")).agg(F.avg(value).alias("mean"))


def label_key(label: str, voxels: DataFrame) -> tuple[Column, Column]:
    """(key, background) to join a label by: a background voxel, as most may be, gets a key of its own, which no table has."""
    ground = F.coalesce(F.col(label) == 0, F.lit(True))
    return F.when(ground, F.xxhash64(*POS) if set(POS) <= set(voxels.columns) else F.xxhash64(*voxels.columns)).otherwise(F.col(label)), ground


def with_entry(voxels: DataFrame, label: str, table: DataFrame, entry: str, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """``voxels`` with ``entry`` of the table's row for their label (and ``by`` columns), null if it has none; background meets nothing."""
    k, ground = label_key(label, voxels)
    other = table.select(*by, F.col(key).alias("_k"), F.lit(False).alias("_ground"), entry)
    return voxels.withColumns({"_k": k, "_ground": ground}).join(other, [*by, "_k", "_ground"], "left").drop("_k", "_ground")


def filter_fragments(voxels: DataFrame, value: str, limit: float, label: str = "label") -> DataFrame:
    """Labels whose mean ``value`` is below ``limit`` become 0."""
    low = means(voxels, value, label).where(F.col("mean") < limit).select("id", F.lit(True).alias("_low"))
    return with_entry(voxels, label, low, "_low").withColumn(label, F.when(F.col("_low"), F.lit(0).cast("long")).otherwise(F.col(label))).select(voxels.columns)


def unique_labels(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.select(F.col(label).alias("id")).distinct()


def label_sizes(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.groupBy(F.col(label).alias("id")).agg(F.count(F.lit(1)).alias("size"))


def without_small(voxels: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Labels of fewer than ``least`` voxels become 0."""
    small = label_sizes(voxels, label).where((F.col("size") < least) & (F.col("id") != 0)).select("id", F.lit(True).alias("_small"))
    return with_entry(voxels, label, small, "_small").withColumn(label, F.when(F.col("_small"), F.lit(0).cast("long")).otherwise(F.col(label))).select(voxels.columns)


def without_small_parts(voxels: DataFrame, least: int, shape: tuple[int, int, int], label: str = "label", full: bool = False) -> DataFrame:
    """Connected parts of a label of fewer than ``least`` voxels become 0; another part of the label may stay."""
    part = label_components(voxels.select(*POS, label), label, shape, full, "_part")
    large = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_part")
    kept = part.join(large, "_part", "left_semi").select(*POS, F.lit(True).alias("_kept"))
    return voxels.join(kept, POS, "left").withColumn(label, F.when(F.col("_kept"), F.col(label)).otherwise(F.lit(0).cast("long"))).select(voxels.columns)


def without_small_holes(voxels: DataFrame, most: int, shape: tuple[int, int, int], mask: str = "masked", full: bool = False) -> DataFrame:
    """A mask with its holes, connected parts outside it, of fewer than ``most`` voxels filled."""
    outside = label_components(voxels.where(~F.col(mask).cast("boolean")).select(*POS, F.lit(1).alias("_one")), "_one", shape, full, "_hole")
    small = outside.groupBy("_hole").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < most).select("_hole")
    filled = outside.join(small, "_hole", "left_semi").select(*POS, F.lit(True).alias("_filled"))
    return voxels.join(filled, POS, "left").withColumn(mask, F.col(mask).cast("boolean") | F.coalesce("_filled", F.lit(False))).select(voxels.columns)


def renumbered(voxels: DataFrame, label: str = "label", by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(voxels with labels 1..n by ascending id, map of id to number). Ids are ranked by ranges: no window over all ids."""
    ids = voxels.where(F.col(label) != 0).select(*by, F.col(label).alias("id")).distinct()
    if by:
        ranked = ids.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("id")).cast("long"))
    else:
        ranked = dense_rank_of(ids, "id", "number")
    joined = with_entry(voxels, label, ranked, "number", by=by)
    return joined.withColumn(label, F.coalesce("number", F.lit(0).cast("long"))).select(voxels.columns), ranked


def dense_rank_of(distinct: DataFrame, key: str, into: str) -> DataFrame:
    """1..n over a table of distinct keys: sorted by ranges, numbered inside them, range counts summed."""
    scratch = Scratch(distinct.sparkSession, "rank")
    ordered = scratch.settle(distinct.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    inside = ordered.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_count")).select("_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    return inside.join(base, "_range").withColumn(into, (F.col("_inside") + F.col("_base")).cast("long")).drop("_range", "_inside", "_base")


def block_unique(label, block_id, voxels_per_block: int):
    """Column: id moved to the block's own range, 0 stays."""
    return F.when(label > 0, label + block_id * F.lit(voxels_per_block)).otherwise(label)


def voxel_key(shape: tuple[int, int, int]):
    """Column: place of a voxel in a dense volume of ``shape``, as a node id."""
    return (F.col("z").cast("long") * shape[1] + F.col("y")) * shape[2] + F.col("x")


def label_components(voxels: DataFrame, value: str, shape: tuple[int, int, int], full: bool = False, into: str = "component", one_value: bool = False, axes: Sequence[str] = AXES) -> DataFrame:
    """Connected voxels of equal non-zero ``value`` share ``into``: the smallest voxel key of them plus 1.

    Blocks find their own components; only those across their sides meet. full: edges and corners connect too; otherwise faces only. one_value: any two non-zero voxels connect. axes: those along which
    voxels connect; without z every section is on its own.
    """
    kept = voxels.where(F.col(value) != 0)
    offsets = tuple(HALF_2) + ((-1, -1, -1), (-1, -1, 1), (-1, 1, -1), (-1, 1, 1)) if full else FACES
    offsets = tuple(o for o in offsets if all(a in axes for a, d in zip(AXES, o, strict=True) if d))
    scratch = Scratch(voxels.sparkSession, "voxels")
    found = scratch.settle(components_in_blocks(kept.withColumn("_key", voxel_key(shape)), offsets, "_key", None if one_value else value))
    # components of blocks join across their sides: a link for each pair of voxels there, so few voxels meet
    border = found.where("_border").select(F.col("_key").alias("_other"), F.col("_root").alias("b")).distinct()
    links = found.where("_other is not null").select(F.col("_root").alias("a"), "_other").join(border, "_other").select("a", "b")
    whole = connected_components(links, whole=500_000).withColumnRenamed("node", "_root")
    joined = found.where("_other is null").join(whole, "_root", "left").withColumn(into, F.coalesce("component", "_root") + 1).select(*kept.columns, into)
    nowhere = kept.where(" or ".join(f"{a} is null" for a in POS))
    return joined.unionByName(nowhere.withColumn(into, F.lit(None).cast("long")))


def grow_boundary(voxels: DataFrame, label: str = "label", steps: int = 1, only_xy: bool = False) -> DataFrame:
    """A voxel with a face neighbour of another label becomes 0, ``steps`` times; outside the volume counts as the same label."""
    faces = FACES[1:] if only_xy else FACES
    both = tuple(faces) + tuple(tuple(-d for d in f) for f in faces)
    scratch, now = Scratch(voxels.sparkSession, "erode"), voxels
    for k in range(steps):
        edge = neighbours(now.select(*POS, label), both, label, "_o", pc.not_equal).select(*POS).distinct().withColumn("_e", F.lit(True))
        now = now.join(edge, POS, "left").withColumn(label, F.when(F.col("_e"), F.lit(0).cast("long")).otherwise(F.col(label))).select(voxels.columns)
        if k + 1 < steps:
            now = scratch.settle(now)
    return now
