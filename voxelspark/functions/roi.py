"""Boxes in world units, half-open, on the driver and as column expressions; voxel and world positions; threshold lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.sources.schema import AXES


def world(index: Column, offset: int | Column, voxel_size: int | Column) -> Column:
    return F.lit(offset) + F.lit(voxel_size) * index


def voxel(position: Column, offset: int | Column, voxel_size: int | Column) -> Column:
    return F.floor((position - F.lit(offset)) / F.lit(voxel_size)).cast("long")


@dataclass(frozen=True)
class Roi:
    """Half-open box: offset and shape per axis. An empty box has a side of 0 or less."""

    off: tuple[int, ...]
    shape: tuple[int, ...]

    @property
    def end(self) -> tuple[int, ...]:
        return tuple(o + s for o, s in zip(self.off, self.shape, strict=True))

    @classmethod
    def between(cls, low, high) -> Roi:
        low = tuple(low)
        return cls(low, tuple(max(0, b - a) for a, b in zip(low, high, strict=True)))

    def empty(self) -> bool:
        return any(s <= 0 for s in self.shape)

    def grow(self, low, high) -> Roi:
        return Roi.between([o - g for o, g in zip(self.off, low, strict=True)], [e + g for e, g in zip(self.end, high, strict=True)])

    def intersect(self, other: Roi) -> Roi:
        return Roi.between(map(max, self.off, other.off), map(min, self.end, other.end))

    def union(self, other: Roi) -> Roi:
        if self.empty() or other.empty():
            return other if self.empty() else self
        return Roi.between(map(min, self.off, other.off), map(max, self.end, other.end))

    def snap(self, grid, mode: str = "grow") -> Roi:
        """To multiples of ``grid``, outwards or inwards (``shrink``)."""
        if mode not in ("grow", "shrink"):
            raise ValueError(mode)
        down, up = lambda x, g: x // g * g, lambda x, g: -(-x // g) * g
        low, high = (down, up) if mode == "grow" else (up, down)
        return Roi.between(map(low, self.off, grid), map(high, self.end, grid))

    def contains(self, other: Roi) -> bool:
        return other.empty() or self.intersect(other) == other

    def holds(self, columns=AXES) -> Column:
        """Predicate on position columns, one range per axis, so that file statistics can skip what lies outside."""
        test = F.lit(not self.empty())
        for c, low, high in zip(columns, self.off, self.end, strict=True):
            test = test & (F.col(c) >= low) & (F.col(c) < high)
        return test

    def voxels(self, offset, voxel_size) -> Roi:
        """The same box in voxel indices."""
        return Roi.between([(o - f) // v for o, f, v in zip(self.off, offset, voxel_size, strict=True)], [-(-(e - f) // v) for e, f, v in zip(self.end, offset, voxel_size, strict=True)])


def box_grow(low: Column, high: Column, before: int, after: int) -> tuple[Column, Column]:
    return low - before, high + after


def box_intersect(low: Column, high: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
    start = F.greatest(low, low2)
    return start, F.greatest(start, F.least(high, high2))


def box_union(low: Column, high: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
    return F.least(low, low2), F.greatest(high, high2)


def box_snap(low: Column, high: Column, grid: int, mode: str = "grow") -> tuple[Column, Column]:
    down, up = lambda c: (F.floor(c / grid) * grid).cast("long"), lambda c: (F.ceil(c / grid) * grid).cast("long")
    return (down(low), up(high)) if mode == "grow" else (up(low), down(high))


def thresholds(spark: SparkSession, low: float, high: float, step: float) -> DataFrame:
    """threshold DECIMAL(6,4): low, low + step, ... below high, each rounded to 2 places."""
    n = max(0, -(-round((high - low) * 10_000) // round(step * 10_000)))
    return spark.range(n).select(F.round(F.lit(low) + F.col("id") * F.lit(step), 2).cast("decimal(6,4)").alias("threshold"))


def halo_blocks(points: DataFrame, block: tuple[int, ...], context: tuple[int, ...], columns=AXES) -> DataFrame:
    """Each point once per block whose read box (the block grown by ``context``) holds it: columns block_<axis> and owned."""
    out, owned = points, F.lit(True)
    for c, b, g in zip(columns, block, context, strict=True):
        first, last = F.floor((F.col(c) - g) / b).cast("int"), F.floor((F.col(c) + g) / b).cast("int")
        out = out.withColumn(f"block_{c}", F.explode(F.sequence(first, last)))
        owned = owned & (F.floor(F.col(c) / b).cast("int") == F.col(f"block_{c}"))
    return out.withColumn("owned", owned)
