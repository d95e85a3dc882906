"""What voxels around each voxel say, block by block: neighbour pairs, weighted moments of objects, maxima, smoothing, distances.

A volume is shuffled once: each voxel goes to its block and to the blocks whose context holds it. Inside a block, which bounds a
group, arrays do the work; a voxel without a position takes no part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxelspark.functions.roi import halo_blocks
from voxelspark.plans.iterate import local_components
from voxelspark.sources.schema import AXES, POS

#: Sides of a block; lines of one bundle along the two axes across it.
BLOCK, BUNDLE = (32, 128, 128), (8, 64)
#: Sides of a block whose voxels leave it many times over.
SMALL = (8, 64, 64)
#: Pairs that one step looks at.
PAIRS = 1 << 19
#: Nanoseconds that a place and an offset of the kernel take where all objects are summed at once.
MOMENT_NS = 8
#: Rows of a large table that one task holds.
ROWS = 1_000_000
#: Places of a line that one task holds.
LENGTH = 1024


def in_blocks(df: DataFrame, context: Sequence[int], block: Sequence[int] = BLOCK, parts: int | None = None):
    """``df`` grouped by block, each with its context; ``owned`` tells the block's own voxels. parts: tasks, if not left to Spark."""
    there, of = F.col("z").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull(), ("block_z", "block_y", "block_x")
    halo = halo_blocks(df.where(there), tuple(block), tuple(context))
    return (halo if parts is None else halo.repartition(parts, *of)).groupBy(*of)


def parts_for(df: DataFrame, rows: int) -> int | None:
    """Tasks that hold about ``ROWS`` rows each, None where Spark's own number does: it follows settings, not rows."""
    parts = -(-rows // ROWS)
    return parts if parts > df.sparkSession.sparkContext.defaultParallelism else None


def places(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(a).to_numpy().astype(np.int64) for a in AXES])


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] of them, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def pairs_in_blocks(df: DataFrame, offsets: Sequence[tuple[int, int, int]], value: str, other: str, keep: Callable | None = None) -> DataFrame:
    """(z, y, x, channel, value, other): each voxel with the one at every offset, where both are there.

    keep: of both values, as Arrow arrays, which pairs are returned; a null answer is no.
    """
    reach = np.array([max(abs(o[k]) for o in offsets) for k in range(3)])
    kind = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([*(T.StructField(a, kind[a]) for a in POS), T.StructField("channel", T.IntegerType()), T.StructField(value, kind[value]), T.StructField(other, kind[value])])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at, owned, values = places(t), np.flatnonzero(t.column("owned").to_numpy()), t.column(value)
        low = at.min(axis=1) - reach
        size = at.max(axis=1) + reach + 1 - low
        key = ((at[0] - low[0]) * size[1] + at[1] - low[1]) * size[2] + at[2] - low[2]
        order = np.argsort(key, kind="stable")
        placed, out = key[order], []
        for k, (dz, dy, dx) in enumerate(offsets):
            want = key[owned] + (dz * size[1] + dy) * size[2] + dx
            first = np.searchsorted(placed, want)
            count = np.searchsorted(placed, want, "right") - first
            i, j = pa.array(np.repeat(owned, count)), pa.array(order[spans(first, count)])
            a, b = values.take(i), values.take(j)
            if keep is not None:
                ok = keep(a, b).fill_null(False)
                i, a, b = i.filter(ok), a.filter(ok), b.filter(ok)
            out.append(pa.table([*(t.column(c).take(i) for c in POS), pa.array(np.full(len(i), k, np.int32)), a, b], [*POS, "channel", value, other]))
        return pa.concat_tables(out)

    return in_blocks(df.select(*POS, value), reach).applyInArrow(run, schema)


def _found_in_block(at: np.ndarray, offsets: Sequence[tuple[int, int, int]], asked: np.ndarray):
    """For each offset (i, j): the rows ``asked`` and those at the offset from them."""
    reach = np.array([max(abs(o[k]) for o in offsets) for k in range(3)])
    low = at.min(axis=1) - reach
    size = at.max(axis=1) + reach + 1 - low
    key = ((at[0] - low[0]) * size[1] + at[1] - low[1]) * size[2] + at[2] - low[2]
    order = np.argsort(key, kind="stable")
    placed = key[order]
    for dz, dy, dx in offsets:
        want = key[asked] + (dz * size[1] + dy) * size[2] + dx
        first = np.searchsorted(placed, want)
        count = np.searchsorted(placed, want, "right") - first
        yield np.repeat(asked, count), order[spans(first, count)]


def pair_counts_in_blocks(df: DataFrame, offsets: Sequence[tuple[int, int, int]], label: str, parts: int | None = None) -> DataFrame:
    """(u, v, n): u < v at an offset from each other, and how often, by block. Pairs are counted before they leave a block."""
    reach, kind = [max(abs(o[k]) for o in offsets) for k in range(3)], df.schema[label].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind), T.StructField("n", T.LongType())])

    def run(t: pa.Table) -> pa.Table:
        names, code = np.unique(t.column(label).to_numpy(), return_inverse=True)
        found = [np.empty(0, np.int64)]
        for i, j in _found_in_block(places(t), offsets, np.flatnonzero(t.column("owned").to_numpy())):
            a, b = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
            found.append((a * len(names) + b)[a < b])
        pair, count = np.unique(np.concatenate(found), return_counts=True)
        u, v = np.divmod(pair, max(1, len(names)))
        return pa.table({"u": names[u], "v": names[v], "n": count})

    return in_blocks(df.select(*POS, label).dropna(subset=[label]), reach, BLOCK, parts).applyInArrow(run, schema)


def components_in_blocks(df: DataFrame, offsets: Sequence[tuple[int, int, int]], key: str, value: str | None) -> DataFrame:
    """``df`` with _root, the smallest ``key`` of a voxel's component inside its block (of equal ``value``, if named), and _border, whether
    it lies at the block's side. And rows that hold nothing else but _root of a voxel and _other, the key of one beside it in another block."""
    names, reach = df.columns, [max(abs(o[k]) for o in offsets) for k in range(3)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), T.StructField("_root", T.LongType()), T.StructField("_border", T.BooleanType()), T.StructField("_other", T.LongType())])
    sides = np.array(BLOCK)[:, None]

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at, owned, node = places(t), t.column("owned").to_numpy(), t.column(key).to_numpy()
        own, i, j = np.flatnonzero(owned), [], []
        for a, b in _found_in_block(at, offsets, own):
            if value is not None:
                alike = pc.equal(t.column(value).take(pa.array(a)), t.column(value).take(pa.array(b))).fill_null(False).to_numpy()
                a, b = a[alike], b[alike]
            i.append(a), j.append(b)
        i, j = np.concatenate(i), np.concatenate(j)
        inside, root = owned[j], node[own].copy()
        found, least = local_components(node[i[inside]], node[j[inside]])
        if len(found):
            place = np.minimum(np.searchsorted(found, root), len(found) - 1)
            root = np.where(found[place] == root, least[place], root)
        of = np.zeros(len(node), np.int64)
        of[own] = root
        seam = pa.table({"_root": of[i[~inside]], "_other": node[j[~inside]]})
        from_side = at[:, own] % sides
        border = ((from_side < np.array(reach)[:, None]) | (from_side >= sides - np.array(reach)[:, None])).any(axis=0)
        kept = pa.table([*(t.column(c).take(pa.array(own)) for c in names), pa.array(root), pa.array(border)], [*names, "_root", "_border"])
        return pa.concat_tables([kept, seam], promote_options="default").select([*names, "_root", "_border", "_other"])

    return in_blocks(df, reach, BLOCK).applyInArrow(run, schema)


def kernel_pairs(probe: DataFrame, source: DataFrame, kernel: Sequence[tuple], keys: Sequence[str], block: Sequence[int] = SMALL) -> DataFrame:
    """(keys, the other columns of ``probe``, dz, dy, dx, w, source_<c> for those of ``source``): each voxel of ``probe`` with the ones of
    ``source`` at the kernel's offsets that have the same keys; a null key meets nothing."""
    reach = [max(abs(o[k]) for o in kernel) for k in range(3)]
    mine, other = [c for c in probe.columns if c not in keys], [c for c in source.columns if c not in (*POS, *keys)]
    kind, kind2 = {f.name: f.dataType for f in probe.schema}, {f.name: f.dataType for f in source.schema}
    steps = [T.StructField(f"d{a}", T.IntegerType()) for a in AXES] + [T.StructField("w", T.DoubleType())]
    schema = T.StructType([*(T.StructField(c, kind[c]) for c in (*keys, *mine)), *steps, *(T.StructField(f"source_{c}", kind2[c]) for c in other)])

    def run(p: pa.Table, s: pa.Table) -> pa.Table:
        p, s = p.combine_chunks(), s.combine_chunks().rename_columns([c.removeprefix("source_") for c in s.column_names])
        n, owner = p.num_rows, np.concatenate([np.zeros(p.num_rows, np.int64), np.zeros(s.num_rows, np.int64)])
        known = np.ones(len(owner), bool)
        for c in keys:
            both = pa.chunked_array([*p.column(c).chunks, *s.column(c).cast(p.schema.field(c).type).chunks])
            known &= both.is_valid().to_numpy()
            codes = both.combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy().astype(np.int64)
            owner = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
        at = np.concatenate([places(p), places(s)], axis=1)
        low = at.min(axis=1) - reach
        size = at.max(axis=1) + reach + 1 - low
        key = ((owner * size[0] + at[0] - low[0]) * size[1] + at[1] - low[1]) * size[2] + at[2] - low[2]
        own, theirs = np.flatnonzero(known[:n]), n + np.flatnonzero(known[n:])
        order = theirs[np.argsort(key[theirs], kind="stable")]
        placed, i, j, of = key[order], [], [], []
        for k, o in enumerate(kernel):
            want = key[own] + (o[0] * size[1] + o[1]) * size[2] + o[2]
            first = np.searchsorted(placed, want)
            count = np.searchsorted(placed, want, "right") - first
            i.append(np.repeat(own, count)), j.append(order[spans(first, count)] - n), of.append(np.full(len(i[-1]), k))
        i, j, of = (pa.array(np.concatenate(x)) for x in (i, j, of))
        table = [pa.array([o[k] for o in kernel], pa.int32()).take(of) for k in range(3)] + [pa.array([float(o[3]) for o in kernel]).take(of)]
        return pa.table([*(p.column(c).take(i) for c in (*keys, *mine)), *table, *(s.column(c).take(j) for c in other)], schema.names)

    cells = [F.floor(F.col(a) / b).cast("int").alias(f"block_{a}") for a, b in zip(AXES, block, strict=True)]
    names = [f"source_{a}" for a in AXES]  # both may be the same table, whose columns a cogroup tells apart by name
    there = halo_blocks(source.select(*(F.col(c).alias(f"source_{c}") for c in source.columns)).dropna(subset=names), tuple(block), tuple(reach), names)
    return probe.dropna(subset=list(AXES)).groupBy(*cells).cogroup(there.groupBy(*(f"block_{a}" for a in names))).applyInArrow(run, schema)


class Kernel:
    """Weights by offset: a line of weights per axis that multiply, or a ball of equal ones. Offsets beyond ``reach`` weigh 0."""

    def __init__(self, lines: Sequence[Sequence[tuple[int, float]]] | None = None, ball: Sequence[tuple] | None = None):
        self.ball = ball is not None
        if self.ball:
            self.reach = np.array([max(abs(o[k]) for o in ball) for k in range(3)])
            self.grid = np.zeros(2 * self.reach + 1)
            for o in ball:
                self.grid[tuple(np.array(o[:3]) + self.reach)] = o[3]
        else:
            self.lines = [np.array([w for _, w in line]) for line in lines]
            self.reach = np.array([len(line) // 2 for line in self.lines])
            self.grid = self.lines[0][:, None, None] * self.lines[1][None, :, None] * self.lines[2][None, None, :]
        used = np.argwhere(self.grid != 0)
        self.offsets, self.weights = used - self.reach, self.grid[tuple(used.T)]


def moments_of_near(place: np.ndarray, probe: np.ndarray, first: np.ndarray, count: np.ndarray, kernel: Kernel, terms) -> np.ndarray:
    """Each voxel of ``probe`` with ``count`` ones of ``place`` from ``first`` on, those of its object that may be near; all objects at
    once, a bounded number of pairs at a time."""
    out, upto, weights, a = np.zeros((len(terms), probe.shape[1])), np.cumsum(count), kernel.grid.ravel(), 0
    while a < probe.shape[1]:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        p, s = np.repeat(np.arange(b - a), count[a:b]), spans(first[a:b], count[a:b])
        d, cell = [], 0
        for axis in range(3):
            d.append(place[axis][s] - probe[axis, a:b][p])
            near = np.abs(d[axis]) <= kernel.reach[axis]
            if not near.all():
                p, s, d = p[near], s[near], [x[near] for x in d]
        for axis in range(3):
            cell = cell * kernel.grid.shape[axis] + d[axis] + kernel.reach[axis]
        w = weights[cell]
        for k, axes in enumerate(terms):
            x = w
            for axis in axes:
                x = x * d[axis]
            out[k, a:b] = np.bincount(p, x, b - a)
        a = b
    return out


def moments_of_pairs(all_: np.ndarray, probe: np.ndarray, kernel: Kernel, terms) -> np.ndarray:
    """Every voxel of an object with every other one."""
    n = probe.shape[1]
    return moments_of_near(all_, probe, np.zeros(n, np.int64), np.full(n, all_.shape[1]), kernel, terms)


def moments_of_offsets(mask: np.ndarray, low: np.ndarray, probe: np.ndarray, kernel: Kernel, terms) -> np.ndarray:
    """An offset of the kernel at a time; ``mask``: the object's box and the kernel's reach around it."""
    out, flat = np.zeros((len(terms), probe.shape[1])), mask.ravel()
    strides = np.array([mask.shape[1] * mask.shape[2], mask.shape[2], 1])
    at = strides @ (probe - low[:, None])
    for o, w in zip(kernel.offsets, kernel.weights, strict=True):
        near = flat[at + strides @ o]
        for k, axes in enumerate(terms):
            if f := w * np.prod(o[list(axes)]):
                out[k] += f * near
    return out


def weighted_along(x: np.ndarray, axis: int, line: Sequence[float]) -> np.ndarray:
    """Sums along ``axis`` of x times the weight of its offset; ``line``: the weights of -r .. r."""
    out, r = np.zeros_like(x), len(line) // 2
    for d, w in zip(range(-r, r + 1), line, strict=True):
        if w and abs(d) < x.shape[axis]:
            to, of = [slice(None)] * 3, [slice(None)] * 3
            to[axis], of[axis] = slice(max(0, -d), x.shape[axis] - max(0, d)), slice(max(0, d), x.shape[axis] + min(0, d))
            out[tuple(to)] += w * x[tuple(of)]
    return out


def moments_of_lines(mask: np.ndarray, low: np.ndarray, probe: np.ndarray, kernel: Kernel, terms) -> np.ndarray:
    """An axis at a time: weights that multiply are applied along x, then y, then z; powers of the offset go with the weights."""

    done: dict[tuple[int, ...], np.ndarray] = {}

    def of(powers: tuple[int, ...]) -> np.ndarray:
        """The object filtered along the last axes, by powers of each."""
        if not powers:
            return mask.astype(float)
        if powers not in done:
            axis = 3 - len(powers)
            line, r = kernel.lines[axis], int(kernel.reach[axis])
            done[powers] = weighted_along(of(powers[1:]), axis, [w * float(d) ** powers[0] for d, w in zip(range(-r, r + 1), line, strict=True)])
        return done[powers]

    at = tuple(probe - low[:, None])
    return np.stack([of(tuple(axes.count(a) for a in range(3)))[at] for axes in terms])


def moments_in_blocks(source: DataFrame, probe: DataFrame | None, kernel: Kernel, terms: dict[str, tuple[int, ...]]) -> DataFrame:
    """(label, z, y, x, a column per term) of every voxel of ``source`` (of ``probe``, a part of it, if given): the weighted sum over
    the voxels of the same label around it of the product of offsets along the term's axes.

    An object in a block is summed in the way that takes the fewest steps: by pairs of voxels that are near along one axis (all such
    objects of a block at once, as there may be as many as voxels), by the kernel's offsets, or axis by axis.
    """
    kinds = {f.name: f.dataType for f in source.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("label", *POS)] + [T.StructField(c, T.DoubleType()) for c in terms])
    rows = source.select("label", *POS, F.lit(True).alias("asked")) if probe is None else source.select("label", *POS).join(probe.select("label", *POS, F.lit(True).alias("asked")), ["label", *POS], "left")
    axes = list(terms.values())

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at, label = places(t), t.column("label").to_numpy()
        asked = np.flatnonzero(t.column("owned").to_numpy() & t.column("asked").fill_null(False).to_numpy())
        # objects one after the other, each along the axis on which the kernel leaves out most
        reach, low = kernel.reach, at.min(axis=1)
        span = at.max(axis=1) - low + 1
        axis = int(np.argmax(span / (2 * reach + 1)))
        order = np.lexsort((at[axis], label))
        place, first = at[:, order], np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        key = number * (span[axis] + reach[axis]) + place[axis] - low[axis]
        owner = np.zeros(len(label), bool)
        owner[asked] = True
        mine = np.flatnonzero(owner[order])
        begin = np.searchsorted(key, key[mine] - reach[axis])
        count = np.searchsorted(key, key[mine] + reach[axis], "right") - begin
        # the steps that each way takes, by object
        own = np.bincount(number[mine], minlength=len(first))
        pairs = np.bincount(number[mine], count, len(first))
        cells = (np.maximum.reduceat(place, first, axis=1) - np.minimum.reduceat(place, first, axis=1) + 1 + 2 * reach[:, None]).astype(float).prod(axis=0)
        offsets = len(kernel.weights) * own + cells
        lines = np.full(len(first), np.inf) if kernel.ball else cells * 6 * int((2 * reach + 1).sum())
        paired = pairs <= np.minimum(offsets, lines)
        out, which = np.zeros((len(axes), len(label))), paired[number[mine]]
        out[:, order[mine[which]]] = moments_of_near(place, place[:, mine[which]], begin[which], count[which], kernel, axes)
        last = np.append(first[1:], len(order))
        for k in np.flatnonzero(~paired & (own > 0)).tolist():
            every = place[:, first[k] : last[k]]
            asks = first[k] + np.flatnonzero(owner[order[first[k] : last[k]]])
            corner = every.min(axis=1) - reach
            mask = np.zeros(tuple(every.max(axis=1) + reach + 1 - corner), bool)
            mask[tuple(every - corner[:, None])] = True
            way = moments_of_lines if lines[k] < offsets[k] else moments_of_offsets
            out[:, order[asks]] = way(mask, corner, place[:, asks], kernel, axes)
        kept = pa.array(asked)
        return pa.table([*(t.column(c).take(kept) for c in ("label", *POS)), *(pa.array(x[asked]) for x in out)], schema.names)

    return in_blocks(rows, kernel.reach).applyInArrow(run, schema)


def _grid_of(at: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """The row at each place of a box, -1 for none; None where a place has several rows."""
    grid, cell = np.full(tuple(size), -1, np.int32), tuple(at - low[:, None])
    grid[cell] = np.arange(at.shape[1])
    return grid if (grid[cell] == np.arange(at.shape[1])).all() else None


def moments_of_shifts(grid: np.ndarray, label: np.ndarray, low: np.ndarray, probe: np.ndarray, other: np.ndarray, kernel: Kernel, terms) -> np.ndarray:
    """All objects at once, a bounded number of probes at a time: of each, the places at the kernel's offsets that are of its object count."""
    code, step = np.where(grid >= 0, label[grid], -1).ravel().astype(np.int32), max(1, (PAIRS >> 2) // len(kernel.weights))
    strides, other = np.array([grid.shape[1] * grid.shape[2], grid.shape[2], 1]), other.astype(np.int32)
    at, offset = strides @ (probe - low[:, None]), kernel.offsets @ strides
    weigh = np.stack([kernel.weights * kernel.offsets[:, list(axes)].prod(axis=1) for axes in terms], axis=1)
    parts = [(code[at[a : a + step, None] + offset] == other[a : a + step, None]).astype(float) @ weigh for a in range(0, len(at), step)]
    return np.concatenate(parts).T


def moments_of_objects(at: np.ndarray, label: np.ndarray, probe: np.ndarray, other: np.ndarray, kernel: Kernel, terms) -> np.ndarray:
    """By term, the weighted sums around each place of ``probe`` over the voxels ``at`` whose ``label`` is ``other``, which need not be the
    probe's own; labels are numbers from 0. An object is summed by near pairs, offsets or lines, whichever is expected to be fastest."""
    reach, out = kernel.reach, np.zeros((len(terms), probe.shape[1]))
    if not probe.shape[1]:
        return out
    low = np.minimum(at.min(axis=1), probe.min(axis=1))
    span = np.maximum(at.max(axis=1), probe.max(axis=1)) - low + 1
    axis = int(np.argmax(span / (2 * reach + 1)))
    order = np.lexsort((at[axis], label))
    place, sorted_ = at[:, order], label[order]
    key, want = (n * (span[axis] + reach[axis]) + p[axis] - low[axis] for n, p in ((sorted_, place), (other, probe)))
    begin = np.searchsorted(key, want - reach[axis])
    count = np.searchsorted(key, want + reach[axis], "right") - begin
    objects = np.unique(other)
    first, last = np.searchsorted(sorted_, objects), np.searchsorted(sorted_, objects, "right")
    number = np.searchsorted(objects, other)
    pairs, asks = np.bincount(number, count), np.bincount(number)
    if len(objects) > 1 and len(kernel.weights) * MOMENT_NS < 500_000 * len(objects) / len(other) and np.prod((span + 2 * reach).astype(float)) <= 8 * PAIRS:
        if (at_most_once := _grid_of(at, low - reach, span + 2 * reach)) is not None:
            return moments_of_shifts(at_most_once, label, low - reach, probe, other, kernel, terms)
    there = last > first
    cells = np.zeros(len(objects))
    if there.any():
        ends = np.stack([first[there], last[there]], axis=1).ravel()
        padded = np.concatenate([place, place[:, -1:]], axis=1)
        cells[there] = (np.maximum.reduceat(padded, ends, axis=1)[:, ::2] - np.minimum.reduceat(padded, ends, axis=1)[:, ::2] + 1 + 2 * reach[:, None]).astype(float).prod(axis=0)
    # nanoseconds that each way takes, by object, from runs of each
    near = 80.0 * pairs
    offsets = len(kernel.weights) * (10.0 * asks + 20_000) + cells
    lines = np.full(len(objects), np.inf) if kernel.ball else 500_000 + cells * 6 * int((2 * reach + 1).sum())
    paired = near <= np.minimum(offsets, lines)
    some = np.flatnonzero(paired[number] & (count > 0))
    out[:, some] = moments_of_near(place, probe[:, some], begin[some], count[some], kernel, terms)
    by = np.argsort(number, kind="stable")
    upto = np.cumsum(asks)
    for k in np.flatnonzero(~paired & there).tolist():
        every, mine = place[:, first[k] : last[k]], by[upto[k] - asks[k] : upto[k]]
        corner, end = every.min(axis=1) - reach, every.max(axis=1) + reach
        mine = mine[((probe[:, mine] >= corner[:, None]) & (probe[:, mine] <= end[:, None])).all(axis=0)]
        asked = probe[:, mine]
        if lines[k] < offsets[k]:
            mask = np.zeros(tuple(end + 1 - corner), bool)
            mask[tuple(every - corner[:, None])] = True
            out[:, mine] = moments_of_lines(mask, corner, asked, kernel, terms)
        else:  # offsets from a probe at the border look beyond the box
            mask = np.zeros(tuple(end + 1 - corner + 2 * reach), bool)
            mask[tuple(every - (corner - reach)[:, None])] = True
            out[:, mine] = moments_of_offsets(mask, corner - reach, asked, kernel, terms)
    return out


def ranks(values: pa.ChunkedArray) -> np.ndarray:
    """The place of each value in their order (structs by their fields), -1 for null. NaN is the largest."""
    known = values.is_valid().to_numpy()
    columns = {f.name: pc.struct_field(values, f.name) for f in values.type} if pa.types.is_struct(values.type) else {"v": values}
    order = pc.sort_indices(pa.table(columns), sort_keys=[(c, "ascending") for c in columns]).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    out[~known] = -1
    return out


def running_max(x: np.ndarray, axis: int, before: int, after: int) -> np.ndarray:
    """Maxima of x[i - before .. i + after] along ``axis`` in three steps a place, whatever the window: the maxima from the start and
    to the end of runs as long as the window (van Herk 1992). Numbers of -1 stand for nothing."""
    x, size = np.moveaxis(x, axis, -1), before + after + 1
    n = x.shape[-1]
    long = -(-(n + size) // size) * size
    runs = np.full((*x.shape[:-1], long), -1, x.dtype)
    runs[..., before : before + n] = x
    runs = runs.reshape(*x.shape[:-1], -1, size)
    ahead = np.maximum.accumulate(runs, axis=-1).reshape(*x.shape[:-1], long)
    back = np.maximum.accumulate(runs[..., ::-1], axis=-1)[..., ::-1].reshape(*x.shape[:-1], long)
    return np.moveaxis(np.maximum(back[..., :n], ahead[..., size - 1 : size - 1 + n]), -1, axis)


def maxima_in_blocks(df: DataFrame, value: str, size: int, axes: Sequence[str], into: str) -> DataFrame:
    """``df`` with the largest ``value`` in a box of ``size`` voxels along each of ``axes``, over the voxels that are there; an even
    box reaches one further back than ahead. Null values count as absent, NaN as the largest."""
    before, after = size // 2, (size - 1) // 2
    schema = T.StructType([*df.schema.fields, T.StructField(into, df.schema[value].dataType)])
    names = df.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at, own = places(t), np.flatnonzero(t.column("owned").to_numpy())
        at -= at.min(axis=1)[:, None]
        rank = ranks(t.column(value))
        grid = np.full(tuple(at.max(axis=1) + 1), -1, np.int64)
        np.maximum.at(grid, tuple(at), rank)
        for a in axes:
            grid = running_max(grid, AXES.index(a), before, after)
        row = np.empty(len(rank) + 1, np.int64)
        row[rank] = np.arange(len(rank))
        best = grid[tuple(at[:, own])]
        top = t.column(value).take(pa.array(row[best], mask=best < 0))
        kept = pa.array(own)
        return pa.table([*(t.column(c).take(kept) for c in names), top], [*names, into])

    reach = [before if a in axes else 0 for a in AXES]
    return in_blocks(df, reach).applyInArrow(run, schema)


def sums_in_blocks(df: DataFrame, value: str, kernel: Kernel, into: str) -> DataFrame:
    """(z, y, x, into): the sum of ``value`` times the weight of its offset over the voxels around each voxel, an axis at a time, for a
    kernel of lines. Voxels that are absent or null count as 0; those at one position add up."""
    kind = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([*(T.StructField(a, kind[a]) for a in POS), T.StructField(into, T.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at, own = places(t), np.flatnonzero(t.column("owned").to_numpy())
        low = at.min(axis=1)
        grid = np.zeros(tuple(at.max(axis=1) + 1 - low))
        np.add.at(grid, tuple(at - low[:, None]), t.column("_v").fill_null(0.0).to_numpy())
        for axis in range(3):
            grid = weighted_along(grid, axis, kernel.lines[axis])
        kept = pa.array(own)
        return pa.table([*(t.column(a).take(kept) for a in POS), pa.array(grid[tuple(at[:, own] - low[:, None])])], schema.names)

    return in_blocks(df.select(*POS, F.col(value).cast("double").alias("_v")), kernel.reach).applyInArrow(run, schema)


def envelope(line: np.ndarray, place: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, f, start) of the parabolas (p - place)**2 + f that are least somewhere on their line, in the order of (line, start);
    each is so from ``start`` to the next one's. Felzenszwalb and Huttenlocher (2012), for all lines at once, in whole numbers."""
    if not len(line):
        return line, place, f, np.zeros(0, np.int64)
    order = np.lexsort((f, place, line))
    line, place, f = line[order], place[order], f[order]
    one = np.append(True, (line[1:] != line[:-1]) | (place[1:] != place[:-1]))  # of several at a place the least
    line, place, f = line[one], place[one], f[one]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    count = np.diff(np.append(first, len(line)))
    longest = np.argsort(-count, kind="stable")
    first, count = first[longest], count[longest]
    v, start, top = np.zeros(len(line), np.int64), np.zeros(len(line), np.int64), np.full(len(first), -1)
    least = np.iinfo(np.int64).min
    for k in range(int(count[0])):
        rows = np.arange(np.searchsorted(-count, -k))  # the lines that have a k-th place
        new, begins = first[rows] + k, np.full(len(rows), least)
        left = rows  # those whose last parabola may be hidden by this one
        while len(left := left[top[left] >= 0]):
            at = first[left] + top[left]
            q, o = new[left], v[at]
            # the first whole place from which the new parabola is no worse
            s = -((f[o] - f[q] - (place[q] - place[o]) * (place[q] + place[o])) // (2 * (place[q] - place[o])))
            hidden = s <= start[at]
            begins[left] = np.where(hidden, least, s)
            top[left[hidden]] -= 1
            left = left[hidden]
        top[rows] += 1
        v[first[rows] + top[rows]], start[first[rows] + top[rows]] = new, begins
    used = spans(first, top + 1)
    used = used[np.argsort(line[used], kind="stable")]
    return line[used], place[v[used]], f[v[used]], start[used]


def on_envelope(line: np.ndarray, start: np.ndarray, at_line: np.ndarray, at_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which parabola of an envelope is least at every asked (line, place), whether there is one)."""
    # parabolas and what is asked meet in the order of (line, place)
    low = at_place.min()
    wide = int(at_place.max() - low) + 2
    ids = np.unique(np.concatenate([line, at_line]), return_inverse=True)[1]
    number, asked = ids[: len(line)], ids[len(line) :]
    begin = number * wide + np.clip(start, low, low + wide - 1) - low
    k = np.searchsorted(begin, asked * wide + at_place - low, "right") - 1
    return k, (k >= 0) & (number[k] == asked)


def lower_envelope(line: np.ndarray, place: np.ndarray, f: np.ndarray, at_line: np.ndarray, at_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least (p - q)**2 + f over the given places q of the same line, whether there is one) for every asked (line, place p).

    Memory follows what is given and asked, not how far places lie apart.
    """
    best, found = np.zeros(len(at_line), np.int64), np.zeros(len(at_line), bool)
    if not len(line) or not len(at_line):
        return best, found
    line, place, f, start = envelope(line, place, f)
    k, found = on_envelope(line, start, at_line, at_place)
    best[found] = ((at_place - place[k]) ** 2 + f[k])[found]
    return best, found


def nearest_along(df: DataFrame, axis: str, value: str, length: int = LENGTH) -> DataFrame:
    """``df`` (z, y, x, ...) with ``value`` (a squared distance, null for none) replaced by its least sum with the squared step along
    ``axis``. A task holds a bundle of lines over ``length`` places, however long the lines are.

    A piece of a line tells which of its parabolas are least somewhere beyond its ends, few as a rule. Those of one line show which of
    them are least within which other piece, and go there: of all that could matter at a place, one from elsewhere is among them.
    """
    across = [a for a in AXES if a != axis]
    names, kind = df.columns, {f.name: f.dataType for f in df.schema}
    bundle = [F.floor(F.col(a) / n).alias(f"_{a}") for a, n in zip(across, BUNDLE, strict=True)]
    piece = F.floor(F.col(axis) / length).cast("long").alias("_piece")
    sides = T.StructType([*(T.StructField(a, kind[a]) for a in across), *(T.StructField(c, T.LongType()) for c in ("_piece", "_from", "_to", "_at", "_f"))])
    sent = T.StructType([*(T.StructField(a, kind[a]) for a in across), *(T.StructField(c, T.LongType()) for c in ("_piece", "_at", "_f"))])

    def line_of(t: pa.Table) -> np.ndarray:
        """A number for the line of each row."""
        one, two = (t.column(a).to_numpy().astype(np.int64) for a in across)
        return (one - one.min()) * int(two.max() - two.min() + 1) + two - two.min()

    def ends(t: pa.Table) -> pa.Table:
        """How far each line goes in a piece, and its parabolas that are least somewhere before or after the piece."""
        t = t.combine_chunks()
        line, place = line_of(t), t.column(axis).to_numpy().astype(np.int64)
        order = np.lexsort((place, line))
        first = np.flatnonzero(np.append(True, np.diff(line[order]) != 0))
        last, number = np.append(first[1:], len(order)) - 1, int(place[0] // length)
        given = np.flatnonzero(t.column(value).is_valid().to_numpy())
        on, at, f, start = envelope(line[given], place[given], t.column(value).take(pa.array(given)).cast(pa.int64()).to_numpy())
        final = np.append(on[1:] != on[:-1], True)[: len(on)]
        out = (start < number * length) | final | (np.append(start[1:], 0)[: len(on)] > (number + 1) * length)
        lone, both = len(first), int(out.sum())
        rows = pa.array(order[np.concatenate([first, first[np.searchsorted(line[order[first]], on[out])]])])
        part = lambda x, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(x, pa.int64()), pa.nulls(after, pa.int64())])
        sides_ = [part(place[order[first]], 0, both), part(place[order[last]], 0, both), part(at[out], lone, 0), part(f[out], lone, 0)]
        return pa.table([*(t.column(a).take(rows) for a in across), pa.array(np.full(lone + both, number)), *sides_], sides.names)

    def share(t: pa.Table) -> pa.Table:
        """What each piece of a line gets from the line's others."""
        t = t.combine_chunks()
        line, number = line_of(t), t.column("_piece").to_numpy()
        whole, known = (np.flatnonzero(t.column(c).is_valid().to_numpy()) for c in ("_from", "_at"))
        low, high, at, f = (t.column(c).fill_null(0).to_numpy() for c in ("_from", "_to", "_at", "_f"))
        on, at, f, start = envelope(line[known], at[known], f[known])
        if not len(on):
            return sent_empty
        k, found = on_envelope(on, start, np.tile(line[whole], 2), np.concatenate([low[whole], high[whole]]))
        n = len(whole)
        count = np.where(found[:n], k[n:] - k[:n] + 1, 0)
        to, which = np.repeat(whole, count), spans(k[:n], count)
        other = at[which] // length != number[to]
        to, which = to[other], which[other]
        rows = pa.array(to)
        return pa.table([*(t.column(a).take(rows) for a in across), pa.array(number[to]), pa.array(at[which]), pa.array(f[which])], sent.names)

    def run(t: pa.Table, more: pa.Table) -> pa.Table:
        t, more = t.combine_chunks().select(names), more.combine_chunks()
        line = line_of(pa.concat_tables([t.select(across), more.select(across)]))
        place, n = t.column(axis).to_numpy().astype(np.int64), t.num_rows
        given = np.flatnonzero(t.column(value).is_valid().to_numpy())
        f = t.column(value).take(pa.array(given)).cast(pa.int64()).to_numpy()
        at, g = more.column("_at").to_numpy(), more.column("_f").to_numpy()
        best, found = lower_envelope(np.append(line[given], line[n:]), np.append(place[given], at), np.append(f, g), line[:n], place)
        return t.set_column(names.index(value), value, pa.array(best, mask=~found))

    sent_empty = to_arrow_schema(sent).empty_table()
    held = df.groupBy(*bundle, piece)
    beyond = held.applyInArrow(ends, sides).groupBy(*bundle).applyInArrow(share, sent)
    return held.cogroup(beyond.groupBy(*bundle, F.col("_piece"))).applyInArrow(run, df.schema)
