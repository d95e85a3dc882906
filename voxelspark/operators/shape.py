"""Shape descriptors: weighted count, mean offset, variance and correlation of the voxels of an object around each voxel.

Channels in 3-D: offset z y x, variance zz yy xx, correlation zy zx yx, size; in 2-D: offset y x, variance yy xx, correlation
yx, size. Labels never mix: objects are summed one by one inside blocks that carry the kernel's reach as context, so the volume is
shuffled once. Sums are over offsets from the voxel itself, so large coordinates lose no digits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi, halo_blocks
from voxelspark.operators.blocks import BLOCK, PAIRS, Kernel, moments_in_blocks, moments_of_objects, places, spans
from voxelspark.operators.voxels import ball, clip01, component_channels, crop, downsampled, gaussian, repeated
from voxelspark.sources.schema import AXES, POS

#: Variance is never below this before it divides.
LEAST_VARIANCE = 1e-3


def context(sigma: Sequence[float], mode: str = "gaussian") -> tuple[float, ...]:
    """World units around a box that its descriptors depend on."""
    if mode not in ("gaussian", "sphere"):
        raise ValueError(f"unknown mode {mode!r}")
    return tuple(s * (3 if mode == "gaussian" else 1) for s in sigma)


def channel_names(dims: int) -> list[str]:
    axes = AXES[3 - dims :]
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]]
    return [*(f"offset_{a}" for a in axes), *(f"var_{a}{a}" for a in axes), *(f"pearson_{a}{b}" for a, b in pairs), "size"]


def _moments(source: DataFrame, probe: DataFrame | None, sd: tuple[float, ...], axes: Sequence[str], mode: str) -> DataFrame:
    """label and position with n, m_<a> and s_<a><b>: weighted sums of 1, d and d*d over the label's voxels (in voxels)."""
    at = {a: AXES.index(a) for a in axes}
    terms = {"n": ()} | {f"m_{a}": (at[a],) for a in axes} | {f"s_{a}{b}": (at[a], at[b]) for i, a in enumerate(axes) for b in axes[i:]}
    kernel = Kernel(ball=ball(sd)) if mode == "sphere" else Kernel([gaussian(s) for s in sd])
    return moments_in_blocks(source, probe, kernel, terms)


def shape_descriptors(voxels: DataFrame, sigma: Sequence[float], voxel_size: Sequence[float] = (1, 1, 1), mode: str = "gaussian", dims: int = 3, components: str | None = None, labels: Sequence[int] | None = None, roi: Roi | None = None, downsample: int = 1) -> DataFrame:
    """(z, y, x, label, one column per channel) of every labelled voxel; a voxel that is absent or 0 has all channels 0.

    sigma: world units per axis (z is ignored in 2-D). roi: voxels that get a row; their neighbours outside still count.
    """
    if dims not in (2, 3):
        raise ValueError("2-D or 3-D only")
    context(sigma, mode)
    axes = AXES[3 - dims :]
    source = voxels.where(F.col("label") != 0).select("label", *POS)
    if labels is not None:
        source = source.where(F.col("label").isin(list(labels)))
    if downsample > 1:
        factor = tuple(downsample if a in axes else 1 for a in AXES)
        coarse = shape_descriptors(downsampled(source, factor), sigma, [v * f for v, f in zip(voxel_size, factor, strict=True)], mode, dims, components)
        key = [f"_c{a}" for a in AXES]
        fine = (source if roi is None else crop(source, roi)).withColumns({k: F.floor(F.col(a) / f).cast("int") for k, a, f in zip(key, AXES, factor, strict=True)})
        chans = [c for c in coarse.columns if c not in ("label", *POS)]
        other = coarse.select("label", *(F.col(a).alias(k) for a, k in zip(AXES, key, strict=True)), *chans)
        return fine.join(other, ["label", *key], "left").select(*POS, "label", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in chans))
    size = dict(zip(AXES, voxel_size, strict=True))
    reach = dict(zip(AXES, sigma, strict=True))
    if mode == "sphere" and len({reach[a] for a in axes}) > 1:
        raise ValueError("a sphere needs one sigma")
    sd = tuple(reach[a] / size[a] if a in axes else 0.0 for a in AXES)
    m = _moments(source, None if roi is None else crop(source, roi), sd, axes, mode)
    far = {a: reach[a] * (0.5 if mode == "sphere" else 1.0) for a in axes}
    mean = {a: F.col(f"m_{a}") / F.col("n") * size[a] for a in axes}

    def cov(a: str, b: str) -> Column:
        return F.col(f"s_{a}{b}") / F.col("n") * (size[a] * size[b]) - mean[a] * mean[b]

    var = {a: F.greatest(cov(a, a), F.lit(LEAST_VARIANCE)) for a in axes}
    chans = [mean[a] / far[a] * 0.5 + 0.5 for a in axes] + [var[a] / reach[a] ** 2 for a in axes]
    chans += [cov(a, b) / F.sqrt(var[a] * var[b]) * 0.5 + 0.5 for i, a in enumerate(axes) for b in axes[i + 1 :]] + [F.col("n")]
    names = channel_names(dims)
    keep = range(len(names)) if components is None else component_channels(components, len(names))
    return m.select(*POS, "label", *(clip01(chans[k]).alias(names[k]) for k in keep))


def channels_of(moments: np.ndarray, sigma: Sequence[float], voxel_size: Sequence[float], dims: int) -> np.ndarray:
    """Channels, in the order of ``channel_names``, of Gaussian moments in the order n, m by axis, s by pair of axes."""
    axes = range(3 - dims, 3)
    n, mean = moments[0], {a: moments[1 + i] / moments[0] * voxel_size[a] for i, a in enumerate(axes)}
    pairs = [(a, b) for i, a in enumerate(axes) for b in list(axes)[i:]]
    cov = {(a, b): moments[1 + dims + k] / n * (voxel_size[a] * voxel_size[b]) - mean[a] * mean[b] for k, (a, b) in enumerate(pairs)}
    var = {a: np.maximum(cov[a, a], LEAST_VARIANCE) for a in axes}
    chans = [mean[a] / sigma[a] * 0.5 + 0.5 for a in axes] + [var[a] / sigma[a] ** 2 for a in axes]
    chans += [cov[a, b] / np.sqrt(var[a] * var[b]) * 0.5 + 0.5 for a, b in pairs if a != b] + [n]
    return np.clip(np.stack(chans), 0.0, 1.0)


def changes_by_joining(voxels: DataFrame, edges: DataFrame, target: Sequence[str], sigma: Sequence[float], voxel_size: Sequence[float] = (1, 1, 1), dims: int = 3) -> DataFrame:
    """(u, v, change): how the squared difference between descriptors and the columns ``target`` of ``voxels`` changes, summed over
    the voxels of labels u and v, where both become one label; a part for each block that holds voxels of both. A voxel without a
    target changes nothing, but counts as a neighbour.

    Weighted sums of two labels add up, so no voxel is copied for an edge: a block gets its voxels once, sums each label around the
    voxels of those it may join, and returns a number an edge.
    """
    axes = range(3 - dims, 3)
    terms = [(), *((a,) for a in axes), *((a, b) for i, a in enumerate(axes) for b in list(axes)[i:])]
    kernel = Kernel([gaussian(s / v if k in axes else 0.0) for k, (s, v) in enumerate(zip(sigma, voxel_size, strict=True))])
    blocks = [f"block_{a}" for a in POS]

    def run(t: pa.Table, e: pa.Table) -> pa.Table:
        if not t.num_rows or not e.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "change": pa.array([], pa.float64())})
        at, u, v = places(t), e.column("u").to_numpy(), e.column("v").to_numpy()
        names, label = np.unique(t.column("label").to_numpy(), return_inverse=True)
        wanted = np.stack([t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in target])
        asked = np.flatnonzero(t.column("owned").to_numpy() & ~np.isnan(wanted).any(axis=0))
        asked = asked[np.argsort(label[asked], kind="stable")]
        first, last = (np.searchsorted(label[asked], np.arange(len(names)), side) for side in ("left", "right"))
        one, two, change = np.searchsorted(names, u), np.searchsorted(names, v), np.zeros(len(u))
        used = np.zeros(len(names), bool)
        used[one], used[two] = True, True
        own = np.flatnonzero(used[label[asked]])
        alone = np.ones((len(terms), len(asked)))
        alone[:, own] = moments_of_objects(at, label, at[:, asked[own]], label[asked[own]], kernel, terms)
        apart = np.zeros(len(asked))
        apart[own] = ((channels_of(alone[:, own], sigma, voxel_size, dims) - wanted[:, asked[own]]) ** 2).sum(axis=0)
        # voxels of one end with the sums of the other, object by object, a bounded number at a time
        mine, other, edge = np.concatenate([one, two]), np.concatenate([two, one]), np.tile(np.arange(len(u)), 2)
        order = np.argsort(other, kind="stable")
        mine, other, edge = mine[order], other[order], edge[order]
        upto, a = np.cumsum(last[mine] - first[mine]), 0
        while a < len(mine):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            size = last[mine[a:b]] - first[mine[a:b]]
            k, of, to = spans(first[mine[a:b]], size), np.repeat(other[a:b], size), np.repeat(edge[a:b], size)
            more = moments_of_objects(at, label, at[:, asked[k]], of, kernel, terms)
            near = more[0] > 0
            k, to = k[near], to[near]
            joint = ((channels_of(alone[:, k] + more[:, near], sigma, voxel_size, dims) - wanted[:, asked[k]]) ** 2).sum(axis=0)
            change += np.bincount(to, joint - apart[k], len(u))
            a = b
        return pa.table({"u": u, "v": v, "change": change})

    there = F.col("z").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull() & (F.col("label") != 0)
    halo = halo_blocks(voxels.where(there).select("label", *POS, *target), BLOCK, tuple(int(r) for r in kernel.reach))
    names = halo.select("label", *blocks).distinct()
    here = edges.join(names.withColumnRenamed("label", "u"), "u").join(names.withColumnRenamed("label", "v"), ["v", *blocks]).select("u", "v", *(F.col(b).alias(f"of_{b}") for b in blocks))
    return halo.groupBy(*blocks).cogroup(here.groupBy(*(f"of_{b}" for b in blocks))).applyInArrow(run, "u long, v long, change double")


def upsampled_descriptors(coarse: DataFrame, roi: Roi, factor: tuple[int, int, int], channel: str) -> DataFrame:
    return repeated(coarse, roi, factor, channel)


def descriptor_target(voxels: DataFrame, sigma, voxel_size=(1, 1, 1), labels_mask: DataFrame | None = None, unlabelled: DataFrame | None = None, **how) -> DataFrame:
    """Descriptors of all voxels with ``weight``: labels_mask replaces the foreground mask, unlabelled (1 = labelled) multiplies."""
    found = shape_descriptors(voxels, sigma, voxel_size, **how).drop("label")
    chans = [c for c in found.columns if c not in POS]
    out = voxels.select(*POS, "label").join(found, POS, "left").select(*POS, "label", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in chans))
    weight = (F.col("label") > 0).cast("int")
    if labels_mask is not None:
        out = out.join(labels_mask.select(*POS, F.col("masked").cast("int").alias("_m")), POS, "left")
        weight = F.coalesce("_m", F.lit(0))
    if unlabelled is not None:
        out = out.join(unlabelled.select(*POS, F.col("masked").cast("int").alias("_u")), POS, "left")
        weight = weight * F.coalesce("_u", F.lit(0))
    return out.withColumn("weight", weight).drop("_m", "_u")


def unmask_background(mask: Column, background_mask: Column) -> Column:
    """In the mask, or not in the background mask."""
    return mask.cast("boolean") | ~background_mask.cast("boolean")
