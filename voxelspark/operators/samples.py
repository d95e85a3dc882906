"""Training samples from volumes: affinities, crops, augmentation, splits, batches. Randomness is a hash of ids and a seed."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi
from voxelspark.operators.evaluate import balance_weights
from voxelspark.operators.labels import grow_boundary
from voxelspark.operators.shape import descriptor_target
from voxelspark.operators.voxels import FACES, dense, minmax, neighbours
from voxelspark.plans.iterate import Scratch
from voxelspark.sources.schema import AXES, POS


def uniform(seed: int, *columns) -> Column:
    """Uniform in [0, 1), the same at every run."""
    return drawn(seed, *columns) / float(1 << 32)


def drawn(seed: int, *columns) -> Column:
    """32 bits of the MD5 of the columns and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def affinities_from_labels(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]] = FACES, label: str = "label") -> DataFrame:
    """(z, y, x, aff_0..): 1 where the voxel at the offset has the same non-zero label."""
    pairs = neighbours(voxels.select(*POS, label), offsets, label, keep=pc.equal).where(F.col(label) > 0)
    hits = pairs.groupBy(*POS).agg(*(F.max((F.col("channel") == k).cast("int")).alias(f"aff_{k}") for k in range(len(offsets))))
    return voxels.select(*POS).join(hits, POS, "left").select(*POS, *(F.coalesce(f"aff_{k}", F.lit(0)).alias(f"aff_{k}") for k in range(len(offsets))))

#: Samples along y and x of a layer in which they are worked on.
ACROSS = 64


def random_crops(voxels: DataFrame, count: int, shape: tuple[int, int, int], mask: str, min_masked: float, seed: int = 0, candidates: int = 8) -> DataFrame:
    """(crop, lo_z, lo_y, lo_x, share): ``count`` boxes whose mask share reaches ``min_masked``.

    Origins are drawn until enough pass: candidates * count at first, then eight times as many a round. ValueError if no origin
    in the volume can pass, which is looked up exactly before a second round.
    """
    if count < 1:
        return _crops(voxels, range(0), shape, mask, seed)
    scratch, start, many, found = Scratch(voxels.sparkSession, "crops"), 0, count * candidates, None
    while True:
        drawn = _crops(voxels, range(start, start + many), shape, mask, seed).where(F.col("share") >= min_masked).orderBy("crop").limit(count)
        found = scratch.settle(drawn if found is None else found.unionByName(drawn))
        if found.count() >= count:
            return found.orderBy("crop").limit(count)
        if not start and _best_share(voxels, shape, mask) < min_masked:
            raise ValueError(f"no box of {shape} has a mask share of {min_masked}")
        start, many = start + many, many * 8


def _extent(voxels: DataFrame):
    ends = voxels.agg(*(F.struct(F.min(a), F.max(a)).alias(a) for a in AXES)).first()
    return [ends[a] if ends[a][0] is not None else (0, -1) for a in AXES]

def _best_share(voxels: DataFrame, shape: tuple[int, int, int], mask: str) -> float:
    """Largest mask share of any box in the volume: masked voxels are summed along an axis after the other."""
    now = voxels.where(F.col(mask).cast("boolean")).select(*POS, F.lit(1).cast("long").alias("n"))
    for a, size, (low, high) in zip(AXES, shape, _extent(voxels), strict=True):
        last = max(low, high + 1 - size)
        lows = F.sequence(F.greatest(F.lit(low), F.col(a) - size + 1), F.least(F.lit(last), F.col(a)))
        spread = now.where((F.col(a) - size + 1 <= last) & (F.greatest(F.lit(low), F.col(a) - size + 1) <= F.least(F.lit(last), F.col(a))))
        now = spread.withColumn(a, F.explode(lows)).groupBy(*POS).agg(F.sum("n").alias("n"))
    return (now.agg(F.max("n")).first()[0] or 0) / (shape[0] * shape[1] * shape[2])


def _crops(voxels: DataFrame, ids: range, shape: tuple[int, int, int], mask: str, seed: int) -> DataFrame:
    """(crop, lo_z, lo_y, lo_x, share) of the boxes of these ids that hold any masked voxel.

    Origins and voxels meet through cells of the box's size: a box lies in at most two cells per axis, so it is an equi-join.
    """
    tries = voxels.sparkSession.range(ids.start, ids.stop).withColumnRenamed("id", "crop")
    for k, (a, size, (low, high)) in enumerate(zip(AXES, shape, _extent(voxels), strict=True)):
        room = max(1, high + 1 - low - size + 1)
        tries = tries.withColumn(f"lo_{a}", (F.floor(uniform(seed + k, "crop") * room) + low).cast("int"))
    cells = tries
    for a, size in zip(AXES, shape, strict=True):
        cells = cells.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(f"lo_{a}") / size), F.floor((F.col(f"lo_{a}") + size - 1) / size))))
    keyed = voxels.where(F.col(mask).cast("boolean")).select(*POS, *(F.floor(F.col(a) / size).alias(f"_c{a}") for a, size in zip(AXES, shape, strict=True)))
    inside = F.lit(True)
    for a, size in zip(AXES, shape, strict=True):
        inside = inside & (F.col(a) >= F.col(f"lo_{a}")) & (F.col(a) < F.col(f"lo_{a}") + size)
    total = shape[0] * shape[1] * shape[2]
    return cells.join(keyed, [f"_c{a}" for a in AXES]).where(inside).groupBy("crop", *(f"lo_{a}" for a in AXES)).agg((F.count(F.lit(1)) / total).alias("share"))


def choose_source(samples: DataFrame, probabilities: dict[str, float], seed: int = 0, key: str = "sample") -> DataFrame:
    """``samples`` with ``source``, drawn by weight."""
    total, at, choice = sum(probabilities.values()), 0.0, None
    u = uniform(seed, key)
    for name, p in probabilities.items():
        at += p / total
        choice = F.when(u < at, name) if choice is None else choice.when(u < at, name)
    return samples.withColumn("source", choice.otherwise(list(probabilities)[-1]))


def mirror_transpose(voxels: DataFrame, shape: tuple[int, int, int], seed: int = 0, key: str = "sample", transpose_xy: bool = True) -> DataFrame:
    """Axes mirrored and x and y swapped by hash bits of each sample; swapping needs equal sides."""
    bits = drawn(seed, key)
    flip = [F.when(F.shiftright(bits, k).bitwiseAND(F.lit(1)) == 1, F.lit(s - 1) - F.col(a)).otherwise(F.col(a)) for k, (a, s) in enumerate(zip(AXES, shape, strict=True))]
    z, y, x = flip
    if transpose_xy and shape[1] == shape[2]:
        swap = F.shiftright(bits, 3).bitwiseAND(F.lit(1)) == 1
        y, x = F.when(swap, x).otherwise(y), F.when(swap, y).otherwise(x)
    return voxels.select(*(c for c in voxels.columns if c not in POS), z.alias("z"), y.alias("y"), x.alias("x"))


def intensity_jitter(voxels: DataFrame, value: str, seed: int = 0, key: str = "sample", scale=(0.9, 1.1), shift=(-0.1, 0.1), noise: float = 0.0) -> DataFrame:
    """value * scale + shift, drawn per sample, and uniform noise per voxel, clipped to [0, 1]."""
    draw = lambda k, r: uniform(seed + k, key) * (r[1] - r[0]) + r[0]
    moved = F.col(value) * draw(1, scale) + draw(2, shift) + (uniform(seed + 3, key, *POS) - 0.5) * 2 * noise
    return voxels.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))


def padded(voxels: DataFrame, roi: Roi, by: tuple[int, int, int], value: str, fill=0) -> DataFrame:
    return dense(voxels, roi.grow(by, by), value, fill)


def sparse_labels(voxels: DataFrame, fraction: float, seed: int = 0, label: str = "label") -> DataFrame:
    """A share of the label ids stays, others become 0; ``unlabelled`` is 1 where a label stayed."""
    keep = (F.col(label) > 0) & (uniform(seed, label) < fraction)
    return voxels.withColumns({"unlabelled": keep.cast("int"), label: F.when(keep, F.col(label)).otherwise(F.lit(0).cast("long"))})


def split(names: DataFrame, column: str, test: int = 10, validation: int = 10) -> DataFrame:
    """``split``: the first names by order are the test set, the next the validation set, the rest for training.

    The few smallest names are picked as a top-k, so no window sees all of them.
    """
    first = names.select(column).distinct().orderBy(column).limit(test + validation)
    ranked = first.withColumn("_n", F.row_number().over(Window.orderBy(column)))  # at most test + validation rows
    part = F.when(F.col("_n") <= test, "test").when(F.col("_n").isNotNull(), "validation").otherwise("train")
    return names.join(F.broadcast(ranked), column, "left").withColumn("split", part).drop("_n")


def up_to_multiple(size: Column, multiple: int) -> Column:
    return (F.ceil(size / multiple) * multiple).cast("long")


def stacked(samples: DataFrame, batch: int, key: str = "sample") -> DataFrame:
    """``batch`` and ``place``: samples in the order of their key, ``batch`` at a time."""
    from voxelspark.operators.labels import dense_rank_of

    ranked = dense_rank_of(samples.select(key).distinct(), key, "_n")
    return samples.join(ranked, key).withColumns({"batch": F.floor((F.col("_n") - 1) / batch), "place": (F.col("_n") - 1) % batch}).drop("_n")


def snapshot(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").parquet(path)


def cut_out(voxels: DataFrame, crops: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The voxels of each crop (crop, lo_z, lo_y, lo_x), with positions from its corner. Boxes and voxels meet through cells of the
    crop's size, at most two per axis."""
    cells = crops.select("crop", *(f"lo_{a}" for a in AXES))
    inside = F.lit(True)
    for a, size in zip(AXES, shape, strict=True):
        cells = cells.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(f"lo_{a}") / size), F.floor((F.col(f"lo_{a}") + size - 1) / size))))
        inside = inside & (F.col(a) >= F.col(f"lo_{a}")) & (F.col(a) < F.col(f"lo_{a}") + size)
    keyed = voxels.withColumns({f"_c{a}": F.floor(F.col(a) / size) for a, size in zip(AXES, shape, strict=True)})
    found = keyed.join(cells, [f"_c{a}" for a in AXES]).where(inside)
    return found.withColumns({a: (F.col(a) - F.col(f"lo_{a}")).cast("int") for a in AXES}).drop(*(f"_c{a}" for a in AXES), *(f"lo_{a}" for a in AXES))


def training_samples(voxels: DataFrame, sigma, shape: tuple[int, int, int], count: int, batch: int = 1, dims: int = 3, boundary_steps: int = 1, min_masked: float = 0.5, seed: int = 0, augment: bool = True, noise: float = 0.01, unlabelled: str | None = None) -> DataFrame:
    """Batches of samples: raw values normalised over the volume, ``count`` random crops whose share of labelled voxels reaches
    ``min_masked``, mirrored, transposed and jittered, boundary-grown labels, descriptors with their weight, affinities with class
    weights of the last one, ``batch`` samples stacked at a time.

    voxels: z, y, x, label, raw and, if named, an ``unlabelled`` column (1 = labelled) that masks the descriptors' weight. Samples lie
    in layers of ACROSS x ACROSS while they are worked on, farther apart than any kernel reaches: so a block holds many of them. augment=False leaves them as they are.
    """
    scratch = Scratch(voxels.sparkSession, "training")
    whole = minmax(voxels.withColumn("_all", F.lit(0)), "raw", ("_all",), "raw").drop("_all")
    crops = scratch.settle(random_crops(voxels.withColumn("_m", F.col("label") > 0), count, shape, "_m", min_masked, seed))
    one = cut_out(whole, crops, shape).withColumnRenamed("crop", "sample")
    if augment:
        one = intensity_jitter(mirror_transpose(one, shape, seed, "sample"), "raw", seed, "sample", noise=noise)
    number = scratch.settle(stacked(one.select("sample").distinct(), batch))
    gap = [s + 2 * int(3 * max(sigma) + 1) + boundary_steps + 1 for s in shape]
    n = F.col("batch") * batch + F.col("place")
    cell = [F.floor(n / (ACROSS * ACROSS)), F.floor(n / ACROSS) % ACROSS, n % ACROSS]
    moved = ["_z", "_y", "_x"]
    apart = number.select("sample", "batch", "place", *((c * g).cast("int").alias(m) for c, g, m in zip(cell, gap, moved, strict=True)))
    now = scratch.settle(one.join(apart, "sample").withColumns({a: F.col(a) + F.col(m) for a, m in zip(AXES, moved, strict=True)}))
    grown = scratch.settle(grow_boundary(now.select(*POS, "label"), steps=boundary_steps, only_xy=dims == 2))
    known = None if unlabelled is None else now.select(*POS, F.col(unlabelled).cast("boolean").alias("masked"))
    target = descriptor_target(grown, sigma, unlabelled=known, dims=dims)
    affinity = balance_weights(affinities_from_labels(grown), "aff_2").withColumnRenamed("weight", "aff_weight")
    out = now.select("batch", "place", "sample", *moved, *POS, "raw").join(target, POS).join(affinity, POS)
    return out.withColumns({a: (F.col(a) - F.col(m)).cast("int") for a, m in zip(AXES, moved, strict=True)}).drop(*moved)


def autocontext(raw: DataFrame, first_pass: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Second-pass input: raw and first-pass channels of the same voxel."""
    return raw.join(first_pass.select(*POS, *channels), POS)
