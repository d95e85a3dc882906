"""Voxel tables: cropping, masks, resampling, neighbours and kernels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi
from voxelspark.operators.blocks import kernel_pairs, pairs_in_blocks
from voxelspark.plans.iterate import Scratch
from voxelspark.sources.schema import AXES, POS

#: Face neighbours at smaller z, y or x; half of the neighbours that share a face or an edge; offsets of the affinity channels.
FACES = ((-1, 0, 0), (0, -1, 0), (0, 0, -1))
HALF_2 = FACES + ((-1, -1, 0), (-1, 1, 0), (-1, 0, -1), (-1, 0, 1), (0, -1, -1), (0, -1, 1))


def crop(df: DataFrame, roi: Roi) -> DataFrame:
    return df.where(roi.holds())


def extent(df: DataFrame) -> DataFrame:
    """One row: lo_ and hi_ (half-open) per axis of the voxels there."""
    return df.agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("top", F.max)))).select(*(c for a in AXES for c in (f"lo_{a}", (F.col(f"top_{a}") + 1).alias(f"hi_{a}"))))


def common_extent(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the box in which both volumes exist. Joins two one-row tables."""
    ea, eb = extent(a), extent(b).select(*(F.col(f"{n}_{x}").alias(f"{n}2_{x}") for x in AXES for n in ("lo", "hi")))
    both = ea.join(eb, F.lit(True))
    return both.select(*(c for x in AXES for c in (F.greatest(f"lo_{x}", f"lo2_{x}").alias(f"lo_{x}"), F.least(f"hi_{x}", f"hi2_{x}").alias(f"hi_{x}"))))


def dense(df: DataFrame, roi: Roi, value: str, fill) -> DataFrame:
    """Every voxel of ``roi`` (in voxels) with ``value``, ``fill`` where the table has none."""
    grid = df.sparkSession.range(1)
    for a, low, high in zip(AXES, roi.off, roi.end, strict=True):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(low), F.lit(high - 1)) if high > low else F.array().cast("array<int>")))
    return grid.drop("id").join(crop(df, roi).select(*POS, value), POS, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def scaled(value: Column, scale: float, shift: float) -> Column:
    return value * scale + shift


def affinity_from_bytes(value: Column) -> Column:
    """0..255 to 0..1."""
    return value.cast("double") / 255


def to_byte(value: Column) -> Column:
    """0..1 to 0..255, cut to whole numbers."""
    return (value * 255).cast("int")


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def minmax(df: DataFrame, value: str, by: Sequence[str] = ("volume",), into: str = "normalized") -> DataFrame:
    """(value - min) / (max - min) per group, 0 where they are equal. A partial aggregate joined back, no window over a volume; the
    aggregate is written first, so the join knows its size and broadcasts it where it is small."""
    ends = Scratch(df.sparkSession, "minmax").settle(df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    span = F.col("_hi") - F.col("_lo")
    return df.join(ends, list(by)).withColumn(into, F.when(span == 0, 0.0).otherwise((F.col(value) - F.col("_lo")) / span)).drop("_lo", "_hi")


def masked(df: DataFrame, value: str, mask: DataFrame, flag: str = "masked") -> DataFrame:
    """``value`` set to 0 outside the mask; a voxel that the mask doesn't have counts as outside."""
    inside = mask.select(*POS, F.col(flag).cast("boolean").alias("_in"))
    return df.join(inside, POS, "left").withColumn(value, F.when(F.coalesce("_in", F.lit(False)), F.col(value)).otherwise(F.lit(0).cast(df.schema[value].dataType))).drop("_in")


def upsampled(df: DataFrame, coarse: DataFrame, value: str, factor: tuple[int, int, int]) -> DataFrame:
    """``df`` with the coarse volume's value at the position divided by ``factor``: an equi-join, the coarse side is never blown up."""
    key = [f"_c{a}" for a in AXES]
    fine = df.withColumns({k: F.floor(F.col(a) / f).cast("int") for k, a, f in zip(key, AXES, factor, strict=True)})
    return fine.join(coarse.select(*(F.col(a).alias(k) for a, k in zip(AXES, key, strict=True)), value), key, "left").drop(*key)


def downsampled(df: DataFrame, factor: tuple[int, int, int]) -> DataFrame:
    """Every factor-th voxel per axis."""
    keep = [F.col(a) % f == 0 for a, f in zip(AXES, factor, strict=True)]
    return df.where(keep[0] & keep[1] & keep[2]).withColumns({a: F.floor(F.col(a) / f).cast("int") for a, f in zip(AXES, factor, strict=True)})


def check_divides(roi: Roi, factor: tuple[int, ...]) -> None:
    if any(o % f or s % f for o, s, f in zip(roi.off, roi.shape, factor, strict=True)):
        raise ValueError(f"{roi} is no multiple of {factor}")


def repeated(coarse: DataFrame, roi: Roi, factor: tuple[int, int, int], value: str) -> DataFrame:
    """The fine volume of ``roi`` (in fine voxels) with each coarse voxel repeated ``factor`` times per axis."""
    check_divides(roi, factor)
    out = coarse
    for a, f, low, high in zip(AXES, factor, roi.off, roi.end, strict=True):
        out = out.where((F.col(a) >= low // f) & (F.col(a) < high // f)).withColumn(a, F.explode(F.sequence(F.col(a) * f, F.col(a) * f + f - 1)))
    return out.select(*POS, value)


def without_ids(df: DataFrame, label: str, ids: Sequence[int], keep: bool = False) -> DataFrame:
    """Labels in ``ids`` (or, with keep, not in them) become 0."""
    hit = F.col(label).isin(list(ids))
    return df.withColumn(label, F.when(~hit if keep else hit, F.lit(0).cast("long")).otherwise(F.col(label)))


def label_masks(label: Column, unlabelled: Column | None = None) -> dict[str, Column]:
    fore = (label > 0).cast("int")
    return {"foreground": fore, "all_ones": F.lit(1), "complement": 1 - fore} | ({"weights": fore * unlabelled.cast("int")} if unlabelled is not None else {})


def without_sections(df: DataFrame, label: str, sections: Sequence[int]) -> DataFrame:
    return df.withColumn(label, F.when(F.col("z").isin(list(sections)), F.lit(0).cast("long")).otherwise(F.col(label)))


def component_channels(components: str, channels: int) -> list[int]:
    """Channels that a digit string names, ascending."""
    found = sorted({int(c) for c in components})
    if len(found) != len(components) or (found and found[-1] >= channels) or not found:
        raise ValueError(f"components {components!r}: digits below {channels}, each once")
    return found


def markers(value: Column, background: float = 30, foreground: float = 150) -> Column:
    """1 for background, 2 for foreground, 0 between."""
    return F.when(value < background, 1).when(value > foreground, 2).otherwise(0)


def reordered(df: DataFrame) -> DataFrame:
    """Columns named x, y, z in the order of an x, y, z store, as z, y, x tables."""
    return df.select(*POS, *(c for c in df.columns if c not in POS))


def at(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(a).alias(names.get(a, a)) for a in df.columns))


def neighbours(df: DataFrame, offsets: Sequence[tuple[int, int, int]], value: str, other: str = "other", keep: Callable | None = None) -> DataFrame:
    """Rows (z, y, x, channel, value, other): each voxel with the one at every offset, where both are there; block by block, the
    volume is shuffled once. keep: of both values, as Arrow arrays, which pairs are returned."""
    return pairs_in_blocks(df, offsets, value, other, keep)


def line_before(df: DataFrame, axis: str, value: str, into: str, step: int = 1) -> DataFrame:
    """``value`` of the voxel one step earlier on the line along ``axis``, null where none is there: a lag with a contiguity check."""
    line = Window.partitionBy(*(a for a in AXES if a != axis)).orderBy(axis)
    return df.withColumn(into, F.when(F.lag(axis, step).over(line) == F.col(axis) - step, F.lag(value, step).over(line)))


def gaussian(sd: float) -> list[tuple[int, float]]:
    """(offset, weight): normalised, radius floor(3 sd + 0.5)."""
    import math

    r = int(3 * sd + 0.5)
    w = [math.exp(-0.5 * (d / sd) ** 2) if sd else 1.0 for d in range(-r, r + 1)]
    return [(d, x / sum(w)) for d, x in zip(range(-r, r + 1), w, strict=True)]


def ball(radius: tuple[float, float, float]) -> list[tuple[int, int, int, float]]:
    """Unit weights in a ball (or ellipse, where a radius is 0); radii in voxels."""
    r = [int(x) for x in radius]
    inside = lambda d: sum((i / x) ** 2 for i, x in zip(d, radius, strict=True) if x) <= 1
    return [(dz, dy, dx, 1.0) for dz in range(-r[0], r[0] + 1) for dy in range(-r[1], r[1] + 1) for dx in range(-r[2], r[2] + 1) if inside((dz, dy, dx))]


def kernel_join(probe: DataFrame, source: DataFrame, kernel: Sequence[tuple], keys: Sequence[str] = ("label",)) -> DataFrame:
    """Rows of ``probe`` with each ``source`` voxel of the same ``keys`` inside the kernel: dz, dy, dx (source - probe) and w. Block by
    block: both volumes are shuffled once, and only pairs leave a block."""
    return kernel_pairs(probe, source, kernel, keys)
