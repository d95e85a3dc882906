"""Over-segmentation: distance to the boundary, seeds at its maxima, and basins by pointer chasing."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.operators.agglomerate import QuantileScore, agglomerate, edge_affinities
from voxelspark.operators.blocks import Kernel, maxima_in_blocks, nearest_along, sums_in_blocks
from voxelspark.operators.labels import block_unique, centers, filter_fragments, label_components, renumbered, voxel_key
from voxelspark.operators.rag import relabel
from voxelspark.operators.voxels import FACES, gaussian, masked, neighbours, without_sections
from voxelspark.plans.iterate import Scratch
from voxelspark.sources.schema import AXES, POS


def boundary_mask(channels: Column, highest: float = 1.0, in_xy: bool = False) -> Column:
    """True where the mean affinity (of channels y and x alone with in_xy) exceeds half the highest value."""
    picked = F.slice(channels, 2, 2) if in_xy else channels
    return F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / F.size(picked) > 0.5 * highest


def nearest_background(voxels: DataFrame, mask: str, axis: str, before: str = "before", after: str = "after") -> DataFrame:
    """Position of the nearest voxel outside the mask on either side along ``axis``, itself included; null where there is none."""
    line = Window.partitionBy(*(a for a in AXES if a != axis)).orderBy(axis)
    hole = F.when(~F.col(mask).cast("boolean"), F.col(axis))
    ahead = F.first(hole, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    return voxels.withColumns({before: F.last(hole, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), after: ahead})


def distance_transform(voxels: DataFrame, mask: str = "masked", axes=AXES, into: str = "distance") -> DataFrame:
    """Exact Euclidean distance, in voxels, to the nearest voxel outside the mask; null where a volume has none.

    An axis at a time: squared distances so far, 0 outside the mask, are carried along its lines by their lower envelope, in steps
    that grow with a line's length, whether or not it has a voxel outside the mask.
    """
    now = voxels.select(*POS, mask, F.when(~F.col(mask).cast("boolean"), F.lit(0)).cast("long").alias("d2"))
    for axis in reversed(axes):
        now = nearest_along(now, axis, "d2")
    return now.select(*POS, mask, F.sqrt("d2").alias(into))


def max_filter(voxels: DataFrame, value: str, size: int, axes=AXES, into: str = "highest") -> DataFrame:
    """Maximum in a box of ``size`` voxels per axis over the voxels that are there; an even box reaches one further back than ahead.
    One shuffle by block for all axes. A voxel without a position takes no part."""
    return maxima_in_blocks(voxels, value, size, axes, into)


def smoothed(voxels: DataFrame, value: str, sd: float, axes=AXES, into: str = "filtered") -> DataFrame:
    """(z, y, x, into): ``value`` smoothed by a Gaussian along ``axes``; absent voxels count as 0. One shuffle by block."""
    return sums_in_blocks(voxels, value, Kernel([gaussian(sd if a in axes else 0) for a in AXES]), into)


def seeds(distances: DataFrame, shape: tuple[int, int, int], value: str = "distance", min_seed_distance: int = 10, axes=AXES, masked_only: bool = False) -> DataFrame:
    """(z, y, x, value, seed): maxima of the box; those that touch by a face (along ``axes``) share one seed, named by their smallest voxel key + 1."""
    top = max_filter(distances, value, min_seed_distance, axes).where(F.col(value) == F.col("highest"))
    if masked_only:
        top = top.where(F.col(value) > 0)
    return label_components(top.select(*POS, value).withColumn("_one", F.lit(1)), "_one", shape, into="seed", axes=axes).drop("_one")


def watershed(distances: DataFrame, shape: tuple[int, int, int], value: str = "distance", min_seed_distance: int = 10, axes=AXES, masked_only: bool = True, max_rounds: int = 40, return_seeds: bool = False):
    """(z, y, x, value, fragment): basins of the seeds; with return_seeds also the seeds (z, y, x, value, seed).

    A voxel that is its box's maximum is a seed and points to itself. Another points to its highest strictly higher face
    neighbour (the smallest key among equals), or, if none is higher, to the highest voxel of its box. Every step climbs, so
    the ends are exactly the seeds; doubling the pointers finds them in a logarithm of the longest path. With masked_only
    background voxels (value 0) take no part.
    """
    scratch = Scratch(distances.sparkSession, "watershed")
    take = distances.where(F.col(value) > 0) if masked_only else distances
    seed = scratch.settle(seeds(distances, shape, value, min_seed_distance, axes, masked_only))
    keyed = take.select(*POS, value).withColumn("key", voxel_key(shape))
    packed = F.struct(F.col(value).alias("d"), (-F.col("key")).alias("k"))
    dense = distances.select(*POS, value).withColumn("key", voxel_key(shape))
    highest = max_filter(dense.withColumn("_p", packed), "_p", min_seed_distance, axes, "_top")
    if masked_only:
        highest = highest.where(F.col(value) > 0)
    faces = tuple(f for f in FACES if any(f[AXES.index(a)] for a in axes))
    both = faces + tuple(tuple(-d for d in f) for f in faces)
    higher = lambda p, o: pc.greater(pc.struct_field(o, "d"), pc.struct_field(p, "d"))
    pairs = neighbours(keyed.select(*POS, packed.alias("_p")), both, "_p", "_o", higher)
    up = pairs.groupBy((-F.col("_p.k")).alias("key")).agg(F.max("_o").alias("_up"))
    start = highest.join(up, "key", "left").join(seed.select(*POS, "seed"), POS, "left")
    to = F.when(F.col("seed").isNotNull(), F.col("key")).otherwise(-F.coalesce(F.col("_up.k"), F.col("_top.k")))
    now = scratch.settle(start.select(*POS, value, "key", "seed", to.alias("to")))
    links = now.select("key", "to", "seed")
    for _ in range(max_rounds):
        far = links.join(links.select(F.col("key").alias("to"), F.col("to").alias("_t")), "to", "left")
        after = scratch.settle(far.select("key", F.coalesce("_t", "to").alias("to"), (F.coalesce("_t", "to") != F.col("to")).alias("moved"), "seed"))
        links = after.select("key", "to", "seed")
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"basins did not settle in {max_rounds} rounds")
    named = links.where("seed is not null").select(F.col("key").alias("to"), F.col("seed").alias("fragment"))
    basin = links.select("key", "to").join(named, "to").select("key", "fragment")
    out = now.select(*POS, value, "key").join(basin, "key").drop("key")
    return (out, seed) if return_seeds else out


def fragments_from_affinities(voxels: DataFrame, shape: tuple[int, int, int], channels: str = "chan", highest: float = 1.0, in_xy: bool = False, min_seed_distance: int = 10, return_seeds: bool = False):
    """(z, y, x, fragment): boundary mask, distance, seeds and basins; in_xy treats every section on its own. With return_seeds
    also (z, y, x, seed)."""
    axes = ("y", "x") if in_xy else AXES
    mask = voxels.select(*POS, boundary_mask(F.col(channels), highest, in_xy).alias("masked"))
    found = distance_transform(mask, axes=axes).withColumn("distance", F.coalesce("distance", F.lit(float(sum(shape)))))
    basins, seed = watershed(found, shape, min_seed_distance=min_seed_distance, axes=axes, return_seeds=True)
    basins = basins.select(*POS, "fragment")
    return (basins, seed.select(*POS, "seed")) if return_seeds else basins


def fragments_from_descriptors(voxels: DataFrame, shape: tuple[int, int, int], offsets=("offset_z", "offset_y", "offset_x"), sd: float = 1.0, min_seed_distance: int = 10, axes=AXES) -> DataFrame:
    """(z, y, x, distance, fragment): the squared offsets, smoothed and turned upside down, stand for the distance."""
    squared = voxels.select(*POS, sum((F.col(c) ** 2 for c in offsets), F.lit(0.0)).alias("_v"))
    now = Scratch(voxels.sparkSession, "smoothed").settle(smoothed(squared, "_v", sd, axes, "_v"))
    top = now.agg(F.max("_v")).first()[0] or 0.0
    return watershed(now.select(*POS, F.round(F.lit(top) - F.col("_v"), 12).alias("distance")), shape, min_seed_distance=min_seed_distance, axes=axes, masked_only=False)


def pre_agglomerate(voxels: DataFrame, fragments: DataFrame, epsilon: float, channels=("aff_z", "aff_y", "aff_x")) -> DataFrame:
    """Fragments merged up to ``epsilon`` by the lower-quartile score."""
    both = fragments.select(*POS, F.col("fragment").alias("label")).join(voxels.select(*POS, *channels), POS)
    _, lut = agglomerate(edge_affinities(both, "label", channels), epsilon, QuantileScore(0.25))
    return relabel(fragments, lut, "fragment", "keep")


def extract_fragments(voxels: DataFrame, shape: tuple[int, int, int], mask: DataFrame | None = None, epsilon: float = 0.0, filter_below: float = 0.0, drop_sections=(), in_xy: bool = False, min_seed_distance: int = 10, block: tuple[int, int, int] | None = None, voxel_size=(1, 1, 1), offset=(0, 0, 0)) -> tuple[DataFrame, DataFrame]:
    """(voxels with ``label``, nodes): the whole stage. voxels: z, y, x, aff_z, aff_y, aff_x.

    The whole volume is one run and has no seams. With ``block``, fragments are split at block borders and numbered inside
    their blocks (``block_labels``), as a block-wise run would.
    """
    names = ("aff_z", "aff_y", "aff_x")
    if mask is not None:
        for c in names:
            voxels = masked(voxels, c, mask)
    scratch = Scratch(voxels.sparkSession, "extract")
    found = fragments_from_affinities(voxels.withColumn("chan", F.array(*names)), shape, in_xy=in_xy, min_seed_distance=min_seed_distance)
    if mask is not None:
        found = masked(found, "fragment", mask)
    found = scratch.settle(found)
    if filter_below > 0:
        with_mean = found.join(voxels.select(*POS, sum((F.col(c) for c in names), F.lit(0.0)).alias("_s")), POS).withColumn("_m", F.col("_s") / len(names))
        found = filter_fragments(with_mean, "_m", filter_below, "fragment").select(*POS, "fragment")
    if epsilon > 0:
        found = pre_agglomerate(voxels, found, epsilon)
    if drop_sections:
        found = without_sections(found, "fragment", drop_sections)
    if block is not None:
        found, _ = block_labels(found, shape, block)
    else:
        found = found.select(*POS, F.col("fragment").cast("long").alias("label"))
    out = scratch.settle(found)
    return out, centers(out, "label", offset, voxel_size)


def block_labels(fragments: DataFrame, shape: tuple[int, int, int], block: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """(voxels with ``label``, (block, fragment, label): the way back) of fragments split at block borders.

    A block's fragments are ranked inside it, from 1, and moved by the block's number times the voxels of a block. So labels are
    unique in the whole volume, stay within the voxels of all blocks, and any block can be numbered on its own. Background stays 0.
    ValueError where 63 bits do not hold the voxels of all blocks, or the keys of the volume's voxels.
    """
    blocks = [-(-s // b) for s, b in zip(shape, block, strict=True)]
    per = block[0] * block[1] * block[2]
    if max(blocks[0] * blocks[1] * blocks[2] * per, shape[0] * shape[1] * shape[2]) >= 1 << 63:
        raise ValueError("63 bits do not hold a label for every voxel of all blocks")
    of = [F.floor(F.col(a) / b).cast("long") for a, b in zip(POS, block, strict=True)]
    number = (of[0] * blocks[1] + of[1]) * blocks[2] + of[2]
    ranked, table = renumbered(fragments.select(*POS, F.col("fragment").cast("long").alias("label"), number.alias("_block")), "label", by=["_block"])
    return ranked.select(*POS, block_unique(F.col("label"), F.col("_block"), per).alias("label")), table.select(F.col("_block").alias("block"), F.col("id").alias("fragment"), block_unique(F.col("number"), F.col("_block"), per).alias("label"))


def stencil(voxels: DataFrame, value: str, kind: str, sd: float = 1.0, into: str = "filtered") -> DataFrame:
    """``sobel`` (gradient size in y and x), ``gaussian`` or ``median`` (3 x 3) of an in-plane image; absent neighbours are left out
    of a median and count as 0 elsewhere."""
    if kind == "gaussian":
        return smoothed(voxels, value, sd, ("y", "x"), into)
    around = tuple((0, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    near = neighbours(voxels.select(*POS, value), around, value)
    if kind == "median":
        return near.groupBy(*POS).agg(F.percentile("other", F.lit(0.5)).alias(into))
    if kind != "sobel":
        raise ValueError(kind)
    smooth = (1, 2, 1)
    gy = F.element_at(F.array(*(F.lit(dy * smooth[dx + 1]) for _, dy, dx in around)), F.col("channel") + 1)
    gx = F.element_at(F.array(*(F.lit(dx * smooth[dy + 1]) for _, dy, dx in around)), F.col("channel") + 1)
    both = near.groupBy(*POS).agg(F.sum(F.col("other") * gy).alias("_gy"), F.sum(F.col("other") * gx).alias("_gx"))
    return both.select(*POS, F.sqrt(F.col("_gy") ** 2 + F.col("_gx") ** 2).alias(into))


def li_threshold(voxels: DataFrame, value: str, tolerance: float = 1e-3, max_rounds: int = 100) -> float:
    """Minimum cross-entropy threshold: the logarithmic mean of the two classes' means, iterated; an aggregate per round."""
    import math

    low, now = voxels.agg(F.min(value), F.avg(value)).first()
    if low is None:
        raise ValueError("no voxels")
    now -= low
    for _ in range(max_rounds):
        v = F.col(value) - low
        below, above = voxels.agg(F.avg(F.when(v <= now, v)), F.avg(F.when(v > now, v))).first()
        if not below or not above:
            break
        after = (below - above) / (math.log(below) - math.log(above))
        if abs(after - now) < tolerance:
            now = after
            break
        now = after
    return now + low
