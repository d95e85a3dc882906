"""Operators that SQL does not express, against brute-force models on small volumes and graphs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import agglomerate as A
from voxelspark.operators import blocks as BL
from voxelspark.operators import fragments as FR
from voxelspark.operators import labels as L
from voxelspark.operators import rag as G
from voxelspark.operators import samples as SM
from voxelspark.operators import shape as SH
from voxelspark.operators import voxels as V
from voxelspark.plans import iterate


def volume(spark, a, name="label", kind="long"):
    pts = [(z, y, x, a[z, y, x].item()) for z, y, x in itertools.product(*map(range, a.shape))]
    return spark.createDataFrame(pts, f"z int, y int, x int, {name} {kind}")


def slow_distance(mask):
    holes = np.argwhere(~mask)
    return np.array([[[math.sqrt(((holes - (z, y, x)) ** 2).sum(axis=1).min()) for x in range(mask.shape[2])] for y in range(mask.shape[1])] for z in range(mask.shape[0])])


@pytest.mark.parametrize("bundle", [(8, 64), (2, 3)])
def test_distances(spark, monkeypatch, bundle):
    """Lines and sections without background among others."""
    monkeypatch.setattr(BL, "BUNDLE", bundle)
    rng = np.random.default_rng(1)
    mask = rng.random((4, 7, 9)) > 0.04
    mask[1], mask[2, 3] = True, True
    got = {(r.z, r.y, r.x): r.distance for r in FR.distance_transform(volume(spark, mask, "masked", "boolean")).collect()}
    want = slow_distance(mask)
    assert all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in np.ndindex(mask.shape)) and len(got) == mask.size
    whole = volume(spark, np.ones((1, 3, 3), bool), "masked", "boolean")
    assert {r.distance for r in FR.distance_transform(whole).collect()} == {None}


def test_lower_envelope():
    rng = np.random.default_rng(2)
    f = rng.integers(0, 40, (30, 25)).astype(float)
    f[rng.random(f.shape) < 0.5] = np.inf
    f[3] = np.inf
    at = np.arange(25)
    want = (f[:, None, :] + (at[:, None] - at[None, :]) ** 2).min(axis=2)
    line, place = np.nonzero(np.isfinite(f))
    asked = np.indices(f.shape).reshape(2, -1)
    shuffled = rng.permutation(len(line))
    best, found = BL.lower_envelope(line[shuffled], place[shuffled], f[line, place].astype(int)[shuffled], *asked)
    assert (found.reshape(f.shape) == np.isfinite(want)).all() and (best == np.where(found, want.ravel(), 0)).all()


def test_long_lines_of_few_voxels(spark):
    """Voxels 10**9 apart: exact distances, in memory that follows the voxels."""
    rng = np.random.default_rng(21)
    at = np.unique(rng.integers(-(10**9), 10**9, 100))
    hole = rng.random(len(at)) < 0.3
    rows = [(0, y, int(x), not h) for y, (a, h) in ((0, (at, hole)), (3, (at[:40] + 7, hole[:40]))) for x, h in zip(a, h, strict=True)]
    got = {(r.y, r.x): r.distance for r in FR.distance_transform(spark.createDataFrame(rows, "z int, y int, x int, masked boolean"), axes=("x",)).collect()}
    for y in (0, 3):
        holes = [x for _, b, x, m in rows if b == y and not m]
        assert all(got[b, x] == min(abs(x - h) for h in holes) for _, b, x, _ in rows if b == y)


@pytest.mark.parametrize("block", [(32, 128, 128), (2, 3, 4)])
def test_maxima_and_smoothing_with_absent_voxels(spark, monkeypatch, block):
    monkeypatch.setattr(BL, "BLOCK", block)
    monkeypatch.setattr(BL.in_blocks, "__defaults__", (block,))
    rng = np.random.default_rng(22)
    rows = [(z, y, x, None if rng.random() < 0.1 else int(rng.integers(0, 50))) for z, y, x in np.ndindex(4, 7, 9) if rng.random() < 0.4]
    rows = [(z, y - 3, x - 3, v) for z, y, x, v in rows]
    v = spark.createDataFrame([*rows, (None, 0, 0, 99)], "z int, y int, x int, v long")
    for size, axes in ((4, ("y", "x")), (3, ("z", "y", "x")), (1, ("x",)), (30, ("z", "x"))):
        low, high = [[k if a in axes else 0 for a in "zyx"] for k in (size // 2, (size - 1) // 2)]
        near = lambda p, q: all(a - b <= o <= a + c for a, b, c, o in zip(p, low, high, q, strict=True))  # noqa: B023, E731
        want = {r[:3]: max((o[3] for o in rows if o[3] is not None and near(r, o[:3])), default=None) for r in [(*r[:3],) for r in rows]}
        got = FR.max_filter(v, "v", size, axes).collect()
        assert {(r.z, r.y, r.x): r.highest for r in got} == want and len(got) == len(rows)
    line = dict(V.gaussian(0.8))
    want = {r[:3]: sum(line.get(o[1] - r[1], 0) * line.get(o[2] - r[2], 0) * (o[3] or 0) for o in rows if o[0] == r[0]) for r in rows}
    got = {(r.z, r.y, r.x): r.filtered for r in FR.stencil(v, "v", "gaussian", 0.8).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    # pairs of values are compared from the first on
    both = v.where("v is not null").withColumn("p", F.struct("v", (-F.col("x")).alias("k")))
    got = {(r.z, r.y, r.x): tuple(r.highest) for r in FR.max_filter(both, "p", 3, ("x",)).collect()}
    known = [r for r in rows if r[3] is not None]
    assert got == {r[:3]: max((o[3], -o[2]) for o in known if o[:2] == r[:2] and abs(o[2] - r[2]) <= 1) for r in known}


def slow_watershed(d, size):
    """Basins of a plane by the rules of ``watershed``: {(y, x): seed key + 1}."""
    h, w = d.shape
    key = lambda p: p[0] * w + p[1]
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    faces = lambda p: [q for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)) if inside(*q)]
    box = lambda p: [(y, x) for y in range(p[0] - size // 2, p[0] + (size - 1) // 2 + 1) for x in range(p[1] - size // 2, p[1] + (size - 1) // 2 + 1) if inside(y, x)]
    on = [p for p in np.ndindex(d.shape) if d[p] > 0]
    seed = {p for p in on if d[p] == max(d[q] for q in box(p))}
    root = {}
    for p in sorted(seed, key=key):
        if p not in root:
            todo, least = [p], key(p)
            while todo:
                q = todo.pop()
                if q not in root:
                    root[q] = least
                    todo += [r for r in faces(q) if r in seed]
    out = {}
    for p in on:
        q = p
        while q not in seed:
            higher = [r for r in faces(q) if d[r] > d[q]] or box(q)
            q = min(higher, key=lambda r: (-d[r], key(r)))
        out[p] = root[q] + 1
    return out


def test_watershed(spark):
    rng = np.random.default_rng(7)
    d = rng.integers(0, 9, (11, 13)).astype(float)
    found, seeds = FR.watershed(volume(spark, d[None], "distance", "double"), (1, 11, 13), min_seed_distance=4, axes=("y", "x"), return_seeds=True)
    want = slow_watershed(d, 4)
    assert {(r.y, r.x): r.fragment for r in found.collect()} == want
    assert {r.seed for r in seeds.collect()} == set(want.values())


def test_fragments_from_affinities(spark):
    rng = np.random.default_rng(3)
    aff = rng.random((9, 12, 2))
    rows = [(0, y, x, [0.0, float(aff[y, x, 0]), float(aff[y, x, 1])]) for y in range(9) for x in range(12)]
    v = spark.createDataFrame(rows, "z int, y int, x int, chan array<double>")
    got, seeds = FR.fragments_from_affinities(v, (1, 9, 12), in_xy=True, min_seed_distance=3, return_seeds=True)
    mask = aff.mean(axis=2) > 0.5
    want = slow_watershed(slow_distance(mask[None])[0], 3)
    assert {(r.y, r.x): r.fragment for r in got.collect()} == want and set(seeds.columns) == {"z", "y", "x", "seed"}


def test_fragments_from_descriptors(spark):
    rng = np.random.default_rng(4)
    off = rng.normal(0, 0.3, (8, 9, 2))
    v = spark.createDataFrame([(0, y, x, float(off[y, x, 0]), float(off[y, x, 1])) for y in range(8) for x in range(9)], "z int, y int, x int, offset_y double, offset_x double")
    got = FR.fragments_from_descriptors(v, (1, 8, 9), ("offset_y", "offset_x"), 1.0, 4, ("y", "x"))
    g = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    g /= g.sum()
    s = np.pad((off**2).sum(axis=2), 3)
    s = sum(g[k] * s[:, k : k + 9] for k in range(7))
    s = sum(g[k] * s[k : k + 8] for k in range(7))
    d = np.round(s.max() - s, 12)
    lift = d + 1  # background takes part too
    assert {(r.y, r.x): r.fragment for r in got.collect()} == slow_watershed(lift, 4)


def test_extracted_fragments(spark):
    rng = np.random.default_rng(5)
    aff = np.where(rng.random((2, 8, 10)) < 0.25, 0.1, 0.9)
    rows = [(z, y, x, *[float(aff[z, y, x])] * 3) for z, y, x in np.ndindex(aff.shape)]
    v = spark.createDataFrame(rows, "z int, y int, x int, aff_z double, aff_y double, aff_x double")
    plain, nodes = FR.extract_fragments(v, aff.shape, in_xy=True, min_seed_distance=3)
    base = {(r.z, r.y, r.x): r.label for r in plain.collect()}
    for z in (0, 1):
        want = slow_watershed(slow_distance(aff[z][None] > 0.5)[0], 3)
        group = lambda m: sorted(sorted(p for p in m if m[p] == s) for s in set(m.values()))
        assert group({(y, x): s for (zz, y, x), s in base.items() if zz == z and s}) == group(want)
    centre = {r.id: (r.center_z, r.center_y, r.center_x) for r in nodes.collect()}
    assert all(np.allclose(centre[s], np.mean([p for p in base if base[p] == s], axis=0)) for s in set(base.values()) - {0}) and 0 not in centre
    cut, _ = FR.extract_fragments(v, aff.shape, in_xy=True, min_seed_distance=3, filter_below=0.85, drop_sections=(1,), block=(1, 4, 5))
    for r in cut.collect():
        mean = np.mean([aff[p] for p in base if base[p] == base.get((r.z, r.y, r.x))]) if base.get((r.z, r.y, r.x)) else 0
        assert (r.label > 0) == (r.z == 0 and mean >= 0.85)
    kept = [r for r in cut.collect() if r.label]
    assert all((a.label == b.label) == (base[a.z, a.y, a.x] == base[b.z, b.y, b.x] and (a.y // 4, a.x // 5) == (b.y // 4, b.x // 5)) for a, b in itertools.combinations(kept, 2))


def slow_score(x, how):
    if isinstance(how, A.MeanScore):
        return 1 - np.mean(x)
    bins = sorted(min(255, int(a * 256)) for a in x)
    return 1 - bins[next(k for k in range(len(bins)) if k + 1 >= how.q * len(bins))] / 255


def slow_merges(samples, threshold, how):
    """Merges lowest edge first: [(u, v, score)]."""
    pool, out = {}, []
    for u, v, a in samples:
        pool.setdefault((u, v), []).append(a)
    if getattr(how, "initmax", False):
        pool = {k: [max(x)] for k, x in pool.items()}
    while pool:
        score, (u, v) = min((slow_score(x, how), k) for k, x in pool.items())
        if score >= threshold:
            break
        out.append((u, v, score))
        new = {}
        for (a, b), x in pool.items():
            a, b = (u if a == v else a), (u if b == v else b)
            if a != b:
                new.setdefault((min(a, b), max(a, b)), []).extend(x)
        pool = new
    return out


SCORES = [A.MeanScore(), A.QuantileScore(0.5), A.QuantileScore(0.25), A.QuantileScore(0.9, True)]


@pytest.mark.parametrize("how", SCORES, ids=str)
def test_merging_in_one_pass_by_rounds_and_greedily(spark, how):
    rng = np.random.default_rng(11)
    samples = [(min(a, b) + 20 * (k % 3), max(a, b) + 20 * (k % 3), float(x)) for k, ((a, b), x) in enumerate(zip(rng.integers(1, 14, (120, 2)).tolist(), rng.random(120), strict=True)) if a != b]
    df = spark.createDataFrame(samples, "u long, v long, aff double")
    rows = lambda h: sorted((r.a, r.b, r.c, round(r.score, 9), r.round) for r in h.collect())
    pairs = lambda t: {(r.fragment, r.segment) for r in t.collect()}
    history, lut = A.agglomerate(df, 0.6, how)
    for whole in (1, 30) if how == SCORES[0] else (30,):
        joined, joined_lut = A.agglomerate(df, 0.6, how, whole=whole)
        assert rows(history) == rows(joined) and pairs(lut) == pairs(joined_lut) and rows(history)
    want = slow_merges(samples, 0.6, how)
    assert sorted(round(s, 9) for _, _, s in want) == sorted(r[3] for r in rows(history))
    few, _ = A.agglomerate(df, 0.6, how, max_merges=4)
    assert [r[3] for r in sorted(rows(few), key=lambda r: r[3])] == sorted(round(s, 9) for _, _, s in want)[:4]


@pytest.mark.parametrize("how", SCORES[:2], ids=str)
def test_merging_of_equal_scores(spark, how):
    """Edges of one score merge alike, whatever the groups: the largest pair of fragments that went into an edge decides."""
    rng = np.random.default_rng(5)
    samples = [(min(a, b), max(a, b), x / 4) for (a, b), x in zip(rng.integers(1, 30, (150, 2)).tolist(), rng.integers(1, 4, 150).tolist(), strict=True) if a != b]
    df = spark.createDataFrame(samples, "u long, v long, aff double")
    found = [sorted((r.a, r.b, r.score, r.round) for r in A.agglomerate(df, 0.6, how, whole=w)[0].collect()) for w in (1000, 60, 30)]
    assert found[0] == found[1] == found[2] and len({r[2] for r in found[0]}) < len(found[0])


class PlainMean:
    """A score of a user's own, without methods for an edge at a time."""

    pool, again, score = A.MeanScore.pool, A.MeanScore.again, A.MeanScore.score


def test_merging_by_joins_alone_and_of_nothing(spark):
    rng = np.random.default_rng(6)
    samples = [(min(a, b), max(a, b), float(x)) for (a, b), x in zip(rng.integers(1, 9, (30, 2)).tolist(), rng.random(30), strict=True) if a != b]
    df = spark.createDataFrame(samples, "u long, v long, aff double")
    found = [A.agglomerate(df, 0.55, how) for how in (A.MeanScore(), PlainMean())]
    one, two = (sorted((r.a, r.b, round(r.score, 9), r.round) for r in h.collect()) for h, _ in found)
    assert one == two and one and {tuple(r) for r in found[0][1].collect()} == {tuple(r) for r in found[1][1].collect()}
    for frame, threshold in ((df.limit(0), 0.5), (df, 0.0)):
        for whole in (0, 100):
            history, lut = A.agglomerate(frame, threshold, whole=whole)
            assert history.isEmpty() and lut.isEmpty() and history.columns == ["a", "b", "c", "score", "round"] and lut.columns == ["fragment", "segment"]


def test_merging_along_a_chain(spark):
    """Scores ascend, so one pair at a time is each other's best: rounds follow the number of groups, not that of merges."""
    n = 3000
    df = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), (1 - (F.col("id") + 1) / (2 * n)).alias("aff"))
    spark.sparkContext.setJobGroup("chain", "chain")
    history, lut = A.agglomerate(df, 0.6, whole=600)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150
    assert sorted((r.a, r.b, r.round) for r in history.collect()) == [(0, k + 1, k) for k in range(n)]
    assert {(r.fragment, r.segment) for r in lut.collect()} == {(k, 0) for k in range(n + 1)}


def first_met(history, pairs):
    """The score at which each pair is one node, replaying merges by score."""
    root, out = {}, {}
    top = lambda x: x if root.get(x, x) == x else top(root[x])
    for r in sorted(history, key=lambda r: (r.round, r.score, r.a, r.b)):
        root[top(r.b)] = top(r.a)
        for p in pairs:
            if p not in out and top(p[0]) == top(p[1]):
                out[p] = r.score
    return out


def test_scores_at_which_pairs_merge(spark):
    rng = np.random.default_rng(12)
    samples = [(min(a, b), max(a, b), float(x)) for (a, b), x in zip(rng.integers(1, 16, (60, 2)).tolist(), rng.random(60), strict=True) if a != b]
    history, _ = A.agglomerate(spark.createDataFrame(samples, "u long, v long, aff double"), 0.7)
    tree, pairs = A.merge_tree(history), list(itertools.combinations(range(1, 17), 2))
    want = first_met(history.collect(), pairs)
    frame = spark.createDataFrame(pairs, "u long, v long")
    got = {(r.u, r.v): r.merge_score for r in A.find_merges(frame, tree).collect()}
    assert len(got) == len(pairs) and want and all((got[p] is None) == (p not in want) and (p not in want or math.isclose(got[p], want[p])) for p in pairs)
    marked = A.mark_edges(frame.withColumns({"merge_score": F.lit(9.0), "agglomerated": F.lit(False)}), tree).collect()
    assert len(marked) == len(pairs) and all(r.agglomerated and (r.merge_score is None) == ((r.u, r.v) not in want) for r in marked)
    nodes = {r.node: r for r in tree.collect()}
    leaves = {n for r in history.collect() for n in (r.a, r.b)}
    assert {n for n, r in nodes.items() if r.level == 0} == leaves and len(nodes) == len(leaves) + history.count()
    assert all(nodes[r.parent].level > r.level for r in nodes.values() if r.parent)


def test_blocks_own_edges(spark):
    rng = np.random.default_rng(13)
    lab = (np.arange(6)[:, None] // 2 * 6 + np.arange(12)[None, :] // 2 + 1)[None]
    aff = rng.random((3, *lab.shape))
    rows = [(z, y, x, int(lab[z, y, x]), *map(float, aff[:, z, y, x])) for z, y, x in np.ndindex(lab.shape)]
    v = spark.createDataFrame(rows, "z int, y int, x int, label long, aff_z double, aff_y double, aff_x double")
    e, n = G.build_rag(v, connectivity=1), L.centers(v)
    one = {(r.u, r.v): r.merge_score for r in A.blockwise_scores(v, e, n, (1, 6, 12), (0, 0, 0), 0.6).collect()}
    whole = {(r.u, r.v): r.merge_score for r in A.find_merges(e, A.merge_tree(A.agglomerate(A.edge_affinities(v), 0.6)[0])).collect()}
    assert one.keys() == whole.keys() and all(one[k] == whole[k] or math.isclose(one[k], whole[k]) for k in one) and any(whole.values())
    parts = A.blockwise_scores(v, e, n, (1, 3, 4), (0, 1, 2), 0.6).collect()
    assert len(parts) == e.count() and {(r.u, r.v) for r in parts} == set(whole)


def plain_samples(lab, aff):
    """[(u, v, affinity)] of each voxel to its predecessor along each axis."""
    out = []
    for at in np.ndindex(lab.shape):
        for axis in range(3):
            other = tuple(p - (k == axis) for k, p in enumerate(at))
            if other[axis] >= 0 and lab[at] != lab[other] and lab[at] and lab[other]:
                out.append((min(lab[at], lab[other]), max(lab[at], lab[other]), aff[(axis, *at)]))
    return [(int(u), int(v), float(x)) for u, v, x in out]


def plain_root(merges):
    root = {}
    top = lambda x: x if root.get(x, x) == x else top(root[x])
    for u, v, _ in merges:
        root[top(v)] = top(u)
    return top


def test_scores_of_several_blocks(spark):
    """Every edge's score is the one at which its ends meet in its owner's read box, merged there lowest edge first."""
    rng = np.random.default_rng(21)
    lab = (np.arange(6)[:, None] // 2 * 6 + np.arange(12)[None, :] // 2 + 1)[None]
    aff = rng.random((3, *lab.shape))
    rows = [(z, y, x, int(lab[z, y, x]), *map(float, aff[:, z, y, x])) for z, y, x in np.ndindex(lab.shape)]
    v = spark.createDataFrame(rows, "z int, y int, x int, label long, aff_z double, aff_y double, aff_x double")
    e, n = G.build_rag(v, connectivity=1), L.centers(v)
    block, context = (1, 3, 4), (0, 1, 2)
    got = {(r.u, r.v): r.merge_score for r in A.blockwise_scores(v, e, n, block, context, 0.6).collect()}
    seen = set()
    for (a, b), score in got.items():
        own = [int(np.mean(p) // k) for p, k in zip(np.nonzero(lab == a), block, strict=True)]
        low, high = ([max(0, o * k - c) for o, k, c in zip(own, block, context, strict=True)], [o * k + k + c for o, k, c in zip(own, block, context, strict=True)])
        box = tuple(slice(x, y) for x, y in zip(low, high, strict=True))
        want, merges = None, slow_merges(plain_samples(lab[box], aff[(slice(None), *box)]), 0.6, A.MeanScore())
        for k in range(1, len(merges) + 1):
            top = plain_root(merges[:k])
            if top(a) == top(b):
                want = merges[k - 1][2]
                break
        assert (score is None) == (want is None) and (want is None or math.isclose(score, want)), (a, b)
        seen.add(want is None)
    assert seen == {True, False} and len(got) == e.count()


def test_fragments_merged_up_to_epsilon(spark):
    rng = np.random.default_rng(22)
    lab = (np.arange(8)[:, None] // 2 * 6 + np.arange(12)[None, :] // 2 + 1)[None]
    aff = rng.random((3, *lab.shape))
    rows = [(z, y, x, int(lab[z, y, x]), *map(float, aff[:, z, y, x])) for z, y, x in np.ndindex(lab.shape)]
    v = spark.createDataFrame(rows, "z int, y int, x int, fragment long, aff_z double, aff_y double, aff_x double")
    got = {(r.z, r.y, r.x): r.fragment for r in FR.pre_agglomerate(v, v.select("z", "y", "x", "fragment"), 0.7).collect()}
    merges = slow_merges(plain_samples(lab, aff), 0.7, A.QuantileScore(0.25))
    top = plain_root(merges)
    assert merges and {at: top(int(lab[at])) for at in got} == got


def test_block_labels(spark):
    rng = np.random.default_rng(23)
    lab = rng.integers(0, 6, (2, 7, 9)) * 1000
    got, table = FR.block_labels(volume(spark, lab, "fragment"), lab.shape, (1, 3, 4))
    here = {(r.z, r.y, r.x): r.label for r in got.collect()}
    back = {r.label: (r.block, r.fragment) for r in table.collect()}
    for z, y, x in np.ndindex(lab.shape):
        b = (z * 3 + y // 3) * 3 + x // 4
        inside = sorted({int(k) for k in lab[z, y // 3 * 3 : y // 3 * 3 + 3, x // 4 * 4 : x // 4 * 4 + 4].ravel()} - {0})
        want = inside.index(lab[z, y, x]) + 1 + b * 12 if lab[z, y, x] else 0
        assert here[z, y, x] == want and (not want or back[want] == (b, lab[z, y, x]))


def test_block_labels_of_a_large_volume(spark):
    """Nine voxels of a volume of 10**15: labels are unique and no number overflows."""
    at = [(0, 0, 0), (0, 0, 1), (99_999, 99_999, 99_999), (99_999, 99_999, 99_998), (50_000, 999, 1000), (50_000, 1000, 1000), (999, 999, 999), (1000, 1000, 1000), (12_345, 67_890, 54_321)]
    v = spark.createDataFrame([(*p, 0.9, 0.9, 0.9) for p in at], "z int, y int, x int, aff_z double, aff_y double, aff_x double")
    got, nodes = FR.extract_fragments(v, (100_000,) * 3, min_seed_distance=3, block=(1000, 1000, 1000))
    label = {(r.z, r.y, r.x): r.label for r in got.collect()}
    assert len(label) == 9 and all(0 < k <= 10**15 for k in label.values()) and nodes.count() == len(set(label.values()))
    assert all((label[p] == label[q]) <= (tuple(c // 1000 for c in p) == tuple(c // 1000 for c in q)) for p, q in itertools.combinations(at, 2))
    with pytest.raises(ValueError):
        FR.block_labels(volume(spark, np.ones((1, 1, 1), np.int64), "fragment"), (1 << 31,) * 3, (1, 1, 1))


def test_extracted_fragments_with_mask_and_epsilon(spark):
    rng = np.random.default_rng(24)
    aff = np.where(rng.random((2, 8, 10)) < 0.25, 0.1, rng.uniform(0.6, 1, (2, 8, 10)))
    v = spark.createDataFrame([(z, y, x, *[float(aff[z, y, x])] * 3) for z, y, x in np.ndindex(aff.shape)], "z int, y int, x int, aff_z double, aff_y double, aff_x double")
    inside = rng.random(aff.shape) < 0.9
    mask = volume(spark, inside.astype(int), "masked", "int")
    shown = np.where(inside, aff, 0.0)
    base = {(r.z, r.y, r.x): r.label for r in FR.extract_fragments(v, aff.shape, mask=mask, in_xy=True, min_seed_distance=3)[0].collect()}
    for z in (0, 1):
        want = slow_watershed(slow_distance(shown[z][None] > 0.5)[0], 3)
        parts = lambda m: sorted(sorted(p for p in m if m[p] == s) for s in set(m.values()))
        assert parts({p[1:]: s for p, s in base.items() if p[0] == z and s}) == parts(want)
    lab = np.zeros(aff.shape, np.int64)
    for p, s in base.items():
        lab[p] = s
    top = plain_root(slow_merges(plain_samples(lab, np.stack([shown] * 3)), 0.35, A.QuantileScore(0.25)))
    merged = {(r.z, r.y, r.x): r.label for r in FR.extract_fragments(v, aff.shape, mask=mask, epsilon=0.35, in_xy=True, min_seed_distance=3)[0].collect()}
    assert merged == {p: top(s) for p, s in base.items()} and set(merged.values()) != set(base.values())


def test_descriptor_merging_scores_touched_edges_alone(spark, monkeypatch):
    """Two rows of four fragments each: same merges as when every edge is scored in every round, but fewer are."""
    lab = np.repeat(np.repeat(np.arange(1, 13).reshape(2, 6), 4, axis=0), 3, axis=1)[None]
    truth = np.where(lab <= 4, 1, np.where(lab <= 6, 2, np.where(lab <= 9, 3, 4)))
    v = volume(spark, lab)
    target = SH.shape_descriptors(volume(spark, truth), (1.0, 2.0, 2.0), dims=2)
    edges = G.build_rag(v, connectivity=1)
    asked, plain = [], A.edge_descriptor_scores
    monkeypatch.setattr(A, "edge_descriptor_scores", lambda voxels, e, *how: asked.append(e.count()) or plain(voxels, e, *how))
    history, lut = A.agglomerate_by_descriptors(v, edges, target, (1.0, 2.0, 2.0), dims=2, threshold=-1e-9)
    got = sorted((r["round"], r.a, r.b, round(r.score, 6)) for r in history.collect())
    now, want, open_, total = lab, [], {(r.u, r.v) for r in edges.collect()}, []
    for k in itertools.count():
        total.append(len(open_))
        scores = {(r.u, r.v): r.score for r in plain(volume(spark, now), spark.createDataFrame(sorted(open_), "u long, v long"), target, (1.0, 2.0, 2.0), (1, 1, 1), 2).collect()}
        best = {x: min((s, e) for e, s in scores.items() if x in e) for e in scores for x in e}
        merges = [(e, s) for e, s in scores.items() if s < -1e-9 and all(best[x] == (s, e) for x in e)]
        if not merges:
            break
        want += [(k, *e, round(s, 6)) for e, s in merges]
        to = {b: a for (a, b), _ in merges}
        now = np.vectorize(lambda x: to.get(x, x))(now)
        open_ = {(min(a, b), max(a, b)) for a, b in ((to.get(a, a), to.get(b, b)) for a, b in open_) if a != b}
        if not open_:
            total.append(0)
            break
    assert got == sorted(want) and len({r[0] for r in got}) >= 2
    assert asked[0] == total[0] and sum(asked[1:]) < sum(total[1 : len(asked)])


def test_descriptor_merging_joins_halves(spark):
    halves = np.zeros((1, 6, 8), int)
    halves[0, 1:5, 1:4], halves[0, 1:5, 4:7] = 1, 2
    v, target = volume(spark, halves), SH.shape_descriptors(volume(spark, (halves > 0).astype(int)), (1, 2, 2), dims=2)
    edges = spark.createDataFrame([(1, 2)], "u long, v long")
    score = A.edge_descriptor_scores(v, edges, target, (1, 2, 2), dims=2).first().score
    alone = {r.id: r.score for r in A.node_descriptor_scores(SH.shape_descriptors(v, (1, 2, 2), dims=2), target, SH.channel_names(2)).collect()}
    assert math.isclose(score, -(alone[1] + alone[2]), rel_tol=1e-9) and score < 0  # the joint object is the target
    history, lut = A.agglomerate_by_descriptors(v, edges, target, (1, 2, 2), dims=2)
    assert [(r.a, r.b) for r in history.collect()] == [(1, 2)] and {(r.fragment, r.segment) for r in lut.collect()} == {(1, 1), (2, 1)}
    apart = SH.shape_descriptors(v, (1, 2, 2), dims=2)
    assert A.agglomerate_by_descriptors(v, edges, apart, (1, 2, 2), dims=2)[0].isEmpty()


def test_sweep_of_the_largest_ids(spark):
    ids = [1, 2**62, 2**63 - 3, 2**63 - 2, 2**63 - 1]
    nodes = spark.createDataFrame([(k,) for k in ids], "id long")
    e = spark.createDataFrame([(ids[1], ids[2], 0.1), (ids[4], ids[3], 0.3), (ids[2], ids[3], 0.5)], "u long, v long, merge_score double")
    got = {(float(r.threshold), r.fragment): r.segment for r in G.segment_sweep(nodes, e, (0.2, 0.4, 0.6)).collect()}
    for t in (0.2, 0.4, 0.6):
        assert {f: s for (u, f), s in got.items() if u == t} == {r.fragment: r.segment for r in G.components_at(nodes, e, t).collect()}


def test_bounded_and_unbounded_graphs(spark):
    rng = np.random.default_rng(15)
    rows = [(int(a), int(b), float(s)) for (a, b), s in zip(rng.integers(0, 80, (150, 2)), rng.random(150), strict=True)]
    e = spark.createDataFrame(rows, "u long, v long, merge_score double")
    found = [{(r.node, r.component) for r in iterate.connected_components(e, "u", "v", whole=w).collect()} for w in (0, 1000)]
    assert found[0] == found[1]
    forests = [{(r.u, r.v, r.merge_score) for r in G.spanning_forest(e, whole=w).collect()} for w in (10, 60, 1000)]
    assert forests[0] == forests[1] == forests[2] and len(forests[0]) == len({n for n, _ in found[0]}) - len({c for _, c in found[0]})


def test_components_over_corners_and_erosion(spark):
    a = np.zeros((2, 4, 4), int)
    a[0, 0, 0] = a[1, 1, 1] = a[0, 2, 2] = a[0, 0, 3] = 5
    faces = {r.component for r in L.label_components(volume(spark, a), "label", a.shape).collect()}
    corners = sorted((r.z, r.y, r.x, r.component) for r in L.label_components(volume(spark, a), "label", a.shape, full=True).collect())
    assert len(faces) == 4 and corners == [(0, 0, 0, 1), (0, 0, 3, 4), (0, 2, 2, 1), (1, 1, 1, 1)]
    b = np.repeat(np.array([1] * 5 + [2] * 6)[None, None], 3, axis=1)
    got = {(r.y, r.x): r.label for r in L.grow_boundary(volume(spark, b), steps=2).collect()}
    assert all(got[y, x] == (0 if x in (3, 4, 5, 6) else b[0, y, x]) for y in range(3) for x in range(11))


def test_li_threshold(spark):
    rng = np.random.default_rng(16)
    v = np.concatenate([rng.normal(20, 3, 300), rng.normal(60, 5, 200)]).clip(1)
    got = FR.li_threshold(spark.createDataFrame([(float(x),) for x in v], "v double"), "v")
    w, now = v - v.min(), (v - v.min()).mean()
    for _ in range(100):
        low, high = w[w <= now].mean(), w[w > now].mean()
        now = (low - high) / (math.log(low) - math.log(high))
    assert abs(got - now - v.min()) < 0.01 and 25 < got < 50


def test_samples(spark):
    rng = np.random.default_rng(17)
    lab = np.kron(rng.integers(0, 4, (6, 6)), np.ones((4, 4), int))[None]
    raw = rng.random(lab.shape) * 9
    v = spark.createDataFrame([(z, y, x, int(lab[z, y, x]), float(raw[z, y, x]), int(x % 2)) for z, y, x in np.ndindex(lab.shape)], "z int, y int, x int, label long, raw double, known int")
    got = SM.training_samples(v, (1, 2, 2), (1, 8, 8), 5, batch=2, dims=2, seed=4, augment=False, unlabelled="known").collect()
    crops = SM.random_crops(v.withColumn("_m", F.col("label") > 0), 5, (1, 8, 8), "_m", 0.5, 4).collect()
    assert len(got) == 5 * 64 and {(r.batch, r.place) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)}
    scaled = (raw - raw.min()) / (raw.max() - raw.min())
    for c in crops:
        own = {(r.y, r.x): r for r in got if r.sample == c.crop}
        part = lab[:, c.lo_y : c.lo_y + 8, c.lo_x : c.lo_x + 8]
        grown = L.grow_boundary(volume(spark, part), only_xy=True)
        labels = {(r.y, r.x): r.label for r in grown.collect()}
        found = {(r.y, r.x): r for r in SH.shape_descriptors(grown, (1, 2, 2), dims=2).collect()}
        assert {p: r.label for p, r in own.items()} == labels
        for (y, x), r in own.items():
            assert math.isclose(r.raw, scaled[0, c.lo_y + y, c.lo_x + x]) and r.weight == (labels[y, x] > 0) * ((c.lo_x + x) % 2)
            assert math.isclose(r.offset_y, found[y, x].offset_y if (y, x) in found else 0, abs_tol=1e-9)
            assert r.aff_1 == (y > 0 and labels[y, x] > 0 and labels[y - 1, x] == labels[y, x])
    assert SM.training_samples(v, (1, 2, 2), (1, 8, 8), 5, batch=2, dims=2, seed=4).count() == 5 * 64


def test_moments_by_every_way(spark):
    rng = np.random.default_rng(18)
    a = rng.random((5, 6, 7)) < 0.6
    pts = np.argwhere(a).T
    kernel, terms = BL.Kernel([[(d, w) for d, w in zip(range(-2, 3), (1.0, 2.0, 3.0, 2.0, 1.0), strict=True)]] * 3), [(), (0,), (2,), (0, 0), (0, 2), (1, 2)]
    low = pts.min(axis=1) - kernel.reach
    mask = np.zeros(tuple(pts.max(axis=1) + kernel.reach + 1 - low), bool)
    mask[tuple(pts - low[:, None])] = True
    ways = [BL.moments_of_pairs(pts, pts[:, ::3], kernel, terms), BL.moments_of_offsets(mask, low, pts[:, ::3], kernel, terms), BL.moments_of_lines(mask, low, pts[:, ::3], kernel, terms)]
    assert np.allclose(ways[0], ways[1]) and np.allclose(ways[0], ways[2])


def test_scratch_tables_end(spark, tmp_path):
    import os

    with iterate.lifetime(spark):
        root = iterate.Scratch(spark, "t").root
        kept = iterate.Scratch(spark, "u")
        kept.settle(spark.range(3)).write.parquet(f"{tmp_path}/out")
        assert os.path.isdir(kept.root.removeprefix("file:"))
    assert not os.path.exists(kept.root.removeprefix("file:")) and not os.path.exists(root) and spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getConf = "spark://host:7077", staticmethod(lambda: Conf)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError):
        iterate.shared_folder(Session)


def test_chains_of_merges(spark, tmp_path, monkeypatch):
    """A chain of 60 merges: levels, ancestors and common ancestors in a few dozen jobs, a row a node for each doubling."""
    n = 60
    history = spark.createDataFrame([(1, k + 2, 1, (k + 1) / 1000, k) for k in range(n)], "a long, b long, c long, score double, round int")
    settled, write = [], iterate.Scratch.settle

    def counted(self, df):
        settled.append(write(self, df))
        return settled[-1]

    monkeypatch.setattr(iterate.Scratch, "settle", counted)
    tree = A.merge_tree(history)
    rows = {r.node: r for r in tree.collect()}
    assert len(rows) == 2 * n + 1 and max(r.level for r in rows.values()) == n and len(settled) < 30
    assert all(rows[n + 2 + k].level == k + 1 and math.isclose(rows[n + 2 + k].score, (k + 1) / 1000) for k in range(n))
    settled.clear()
    pairs = [(u, v) for u in (1, 2, 30, 61) for v in (1, 3, 7, 30, 60, 61, 62, 9999)]
    got = {(r.u, r.v): r.merge_score for r in A.find_merges(spark.createDataFrame(pairs, "u long, v long"), tree).collect()}
    want = {(u, v): (max(u, v) - 1) / 1000 if u != v and v <= n + 1 else None for u, v in pairs}
    assert got.keys() == want.keys() and all(got[p] == want[p] or math.isclose(got[p], want[p]) for p in pairs)
    assert len(settled) < 60 and sum(df.count() for df in settled) < 4 * (2 * n + 1) * 10
    few = A.merge_tree(history.where("round < 20"))
    up, above = {r.node: r.parent for r in few.collect()}, {}
    for r in A.ancestors(few).collect():
        above.setdefault(r.node, []).append(r.ancestor)
    line = lambda x: [x, *line(up[x])] if up[x] else [x]
    assert {k: sorted(v) for k, v in above.items()} == {k: sorted(line(k)) for k in up}


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_sweep_over_many_thresholds(spark, fan):
    """Components at 20 thresholds, cut by cut, against a plain search; nodes without edges, ends that are no nodes, ties at a cut."""
    rng = np.random.default_rng(31)
    edges = [(int(a), int(b), round(float(s), 2)) for a, b, s in zip(rng.integers(1, 40, 60), rng.integers(1, 40, 60), rng.random(60), strict=True)]
    cuts = [round(0.05 * k, 2) for k in range(20)]
    nodes, frame = spark.createDataFrame([(k,) for k in range(3, 50)], "id long"), spark.createDataFrame([*edges, (1, 3, None)], "u long, v long, merge_score double")
    got = {(float(r.threshold), r.fragment): r.segment for r in G.segment_sweep(nodes, frame, cuts, fan=fan).collect()}
    want = {}
    for t in cuts:
        root = {k: k for k in range(1, 50)}
        for a, b, s in edges:
            if s <= t and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
        want |= {(t, k): root[k] for k in range(3, 50)}
    assert got == want
    assert G.segment_sweep(nodes, frame, []).isEmpty()


def test_an_edge_of_a_group_is_loaded_once():
    import pyarrow as pa

    from voxelspark.operators import agglomerate as A

    asked = []

    class Counted(A.QuantileScore):
        def load(self, state):
            asked.append(len(state))
            return super().load(state)

    n = 6_000  # a chain whose last edge leaves the group: 0 - 1 - ... - n
    pairs = [(k, k + 1, end) for k in range(n) for end in (k, k + 1) if end < n]
    u, v, end = ([p[i] for p in pairs] for i in range(3))
    state = pa.array([[(k % 7, 1), (9, k + 1)] for k in u], pa.map_(pa.int32(), pa.int64()))
    tie = pa.StructArray.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    score = pa.array([k / n for k in u])
    t = pa.table({"n": end, "u": u, "v": v, "state": state, "tie": tie, "hu": pa.array([k % 5 for k in u], pa.int32()), "hv": pa.array([k % 5 for k in v], pa.int32()), "score": score})
    edges, heights, inside = A.edges_of_group(t, Counted(0.25))
    assert sum(asked) == n and max(asked) <= A.LOADED
    assert sorted(edges) == [[k, k + 1, {k % 7: 1, 9: k + 1}, k / n, (k, k + 1)] for k in range(n)]
    assert heights == {k: k % 5 for k in range(n + 1)} and inside == set(range(n))
