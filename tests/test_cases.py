"""Small hand-made cases, brute-force models and invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi, thresholds
from voxelspark.operators import agglomerate as A
from voxelspark.operators import blocks as BL
from voxelspark.operators import evaluate as EV
from voxelspark.operators import fragments as FR
from voxelspark.operators import labels as L
from voxelspark.operators import rag as G
from voxelspark.operators import shape as SH
from voxelspark.operators import voxels as V
from voxelspark.plans.iterate import connected_components
from voxelspark.sources.graph import RagStore
from voxelspark.sources.schema import checked_ids


def volume(spark, a):
    pts = [(z, y, x, int(a[z, y, x])) for z, y, x in itertools.product(*map(range, a.shape))]
    return spark.createDataFrame(pts, "z int, y int, x int, label long")


def edges(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, merge_score double")


def test_roi():
    a, b = Roi((0, 0, 0), (10, 10, 10)), Roi((5, 5, 5), (10, 10, 10))
    assert a.intersect(b) == Roi((5, 5, 5), (5, 5, 5)) and a.union(b) == Roi((0, 0, 0), (15, 15, 15))
    assert Roi((3, 3, 3), (4, 4, 4)).snap((4, 4, 4)) == Roi((0, 0, 0), (8, 8, 8)) and Roi((3, 3, 3), (4, 4, 4)).snap((4, 4, 4), "shrink").empty()
    assert a.contains(Roi((1, 1, 1), (2, 2, 2))) and not a.contains(b) and a.grow((1, 1, 1), (2, 2, 2)) == Roi((-1, -1, -1), (13, 13, 13))


def test_thresholds(spark):
    got = [float(r[0]) for r in thresholds(spark, 0.0, 1.0, 0.02).collect()]
    assert got == [round(k * 0.02, 2) for k in range(50)]


def test_cube_is_symmetric(spark):
    a = np.zeros((9, 9, 9), int)
    a[3:6, 3:6, 3:6] = 1
    got = {(r.z, r.y, r.x): r for r in SH.shape_descriptors(volume(spark, a), (2, 2, 2)).collect()}
    mid = got[4, 4, 4]
    assert len(got) == 27
    assert all(math.isclose(mid[c], 0.5, abs_tol=1e-9) for c in ("offset_z", "offset_y", "offset_x", "pearson_zy", "pearson_zx", "pearson_yx"))
    doubled = {(r.z, r.y, r.x): r for r in SH.shape_descriptors(volume(spark, a), (4, 4, 4), (2, 2, 2)).collect()}
    assert all(math.isclose(got[p][c], doubled[p][c], abs_tol=1e-6) for p in got for c in ("offset_z", "pearson_yx", "size"))


def brute(a, sigma):
    """Descriptors of a 3-D label array, straight from the definition."""
    r = int(3 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    g /= g.sum()
    pts = np.argwhere(a > 0)
    out = {}
    for p in pts:
        d = pts[a[tuple(pts.T)] == a[tuple(p)]] - p
        d = d[(np.abs(d) <= r).all(axis=1)]
        w = g[d[:, 0] + r] * g[d[:, 1] + r] * g[d[:, 2] + r]
        n = w.sum()
        m = (w[:, None] * d).sum(axis=0) / n
        c = (w[:, None, None] * d[:, :, None] * d[:, None, :]).sum(axis=0) / n - np.outer(m, m)
        v = np.maximum(np.diag(c), 1e-3)
        rho = [c[i, j] / np.sqrt(v[i] * v[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
        out[tuple(p)] = np.clip([*(m / sigma * 0.5 + 0.5), *(v / sigma**2), *(np.array(rho) * 0.5 + 0.5), n], 0, 1)
    return out


@pytest.mark.parametrize("block", [(32, 128, 128), (2, 3, 2)])
def test_descriptors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(BL.in_blocks, "__defaults__", (block,))
    a = np.random.default_rng(3).integers(0, 3, (4, 6, 5))
    want = brute(a, 1.2)
    got = {(r.z, r.y, r.x): [r[c] for c in SH.channel_names(3)] for r in SH.shape_descriptors(volume(spark, a), (1.2, 1.2, 1.2)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p], atol=1e-6) for p in want)


def test_touching_cubes_do_not_mix(spark):
    a = np.zeros((3, 3, 6), int)
    a[:, :, :3], a[:, :, 3:] = 1, 2
    both = {(r.z, r.y, r.x): r for r in SH.shape_descriptors(volume(spark, a), (1, 1, 1)).collect()}
    one = SH.shape_descriptors(volume(spark, np.where(a == 1, 1, 0)), (1, 1, 1)).collect()
    assert all(math.isclose(both[r.z, r.y, r.x][c], r[c], abs_tol=1e-9) for r in one for c in SH.channel_names(3))


def test_bad_arguments(spark):
    v = volume(spark, np.ones((1, 2, 2), int))
    for bad in ({"dims": 1}, {"mode": "cube"}, {"components": "77"}):
        with pytest.raises(ValueError):
            SH.shape_descriptors(v, (1, 1, 1), **bad)
    with pytest.raises(ValueError):
        V.check_divides(Roi((0, 0, 0), (1, 3, 3)), (1, 2, 2))


def test_chain_is_cut(spark, rows):
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "id long")
    e = edges(spark, [(1, 2, 0.1), (2, 3, 0.5), (3, 4, 0.3), (4, 9, None)])
    at = lambda t: {r.fragment: r.segment for r in G.components_at(nodes, e, t).collect()}
    assert at(0.3) == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9} and at(0.5) == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9} and at(0.05) == {k: k for k in (1, 2, 3, 4, 9)}
    sweep = {(float(r.threshold), r.fragment): r.segment for r in G.segment_sweep(nodes, e, (0.05, 0.3, 0.5)).collect()}
    assert sweep == {(t, f): s for t in (0.05, 0.3, 0.5) for f, s in at(t).items()}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 130)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in pairs:
        ra, rb = find(a), find(b)
        label[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for a, b in pairs if a != b for n in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == want


def greedy(samples, threshold):
    pool = {}
    for u, v, a in samples:
        pool.setdefault((u, v), []).append(a)
    merges = []
    while pool:
        (u, v), score = min(((k, 1 - np.mean(x)) for k, x in pool.items()), key=lambda t: (t[1], t[0]))
        if score >= threshold:
            break
        merges.append((u, v, round(score, 6)))
        new = {}
        for (a, b), x in pool.items():
            a, b = (u if a == v else a), (u if b == v else b)
            if a != b:
                new.setdefault((min(a, b), max(a, b)), []).extend(x)
        pool = new
    return merges


def test_rounds_equal_the_greedy_order(spark):
    rng = np.random.default_rng(11)
    samples = [(min(a, b), max(a, b), float(x)) for (a, b), x in zip(rng.integers(1, 14, (40, 2)).tolist(), rng.random(40), strict=True) if a != b]
    want = greedy(samples, 0.7)
    history, lut = A.agglomerate(spark.createDataFrame(samples, "u long, v long, aff double"), 0.7)
    assert sorted(round(r.score, 6) for r in history.collect()) == sorted(s for _, _, s in want)
    parent = {}
    for u, v, _ in want:
        parent[v] = u
    root = lambda x: root(parent[x]) if x in parent else x
    group = lambda m: sorted(map(sorted, {s: [f for f in m if m[f] == s] for s in m.values()}.values()))
    merged = {n for u, v, _ in want for n in (u, v)}
    assert group({r.fragment: r.segment for r in lut.collect()}) == group({n: root(n) for n in merged})
    tree = A.merge_tree(history)
    pairs = spark.createDataFrame([(a, b) for a in range(1, 14) for b in range(a + 1, 14)], "u long, v long")
    found = {(r.u, r.v): r.merge_score for r in A.find_merges(pairs, tree).collect()}
    same = {k for k in found if k[0] in merged and k[1] in merged and root(k[0]) == root(k[1])}
    assert {k for k, s in found.items() if s is not None} == same and all(found[k] < 0.7 for k in same)


def test_distance_and_watershed(spark):
    a = np.ones((1, 9, 14), int)
    a[0, :, 7] = 0
    mask = volume(spark, a).select("z", "y", "x", (F.col("label") > 0).alias("masked"))
    dist = FR.distance_transform(mask, axes=("y", "x"))
    got = {(r.y, r.x): r.distance for r in dist.collect()}
    assert all(math.isclose(got[y, x], abs(x - 7)) for y in range(9) for x in range(14))
    basins = FR.watershed(dist, (1, 9, 14), min_seed_distance=4, axes=("y", "x")).collect()
    assert len({r.fragment for r in basins if r.x < 7}) == len({r.fragment for r in basins if r.x > 7}) == 1 and len({r.fragment for r in basins}) == 2 and len(basins) == 9 * 13


def test_scores(spark):
    pairs = spark.createDataFrame([(1, 1)] * 4 + [(2, 2)] * 3, "a long, b long")
    one = EV.rand_voi(EV.contingency(pairs, "a", "b")).first()
    assert (abs(one.voi_split), abs(one.voi_merge), one.rand_split, one.rand_merge) == (0, 0, 1, 1)
    sites = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id long, component_id long")
    bones = spark.createDataFrame([(0, 1, 2, 3.0), (0, 2, 3, 4.0)], "component_id long, source long, target long, length double")
    clean = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id long, segment long")
    assert EV.expected_run_length(bones, sites, clean).first().erl == 7.0
    shared = clean.union(spark.createDataFrame([(4, 5)], "id long, segment long"))
    assert EV.expected_run_length(bones, sites, shared).first().erl == 0.0


def test_empty_volume(spark):
    none = volume(spark, np.zeros((1, 2, 2), int)).where("label > 0")
    assert G.build_rag(none).isEmpty() and L.centers(none).isEmpty() and SH.shape_descriptors(none, (1, 1, 1)).isEmpty()
    assert L.label_components(none, "label", (1, 2, 2)).isEmpty()


def test_store_modes(spark, tmp_path):
    nodes = spark.createDataFrame([(3, 0.0, 1.0, 1.0), (9, 0.0, 5.0, 5.0)], "id long, center_z double, center_y double, center_x double")
    e = spark.createDataFrame([(9, 3, 0.5, False)], "u long, v long, merge_score double, agglomerated boolean")
    with pytest.raises(PermissionError):
        RagStore(spark, str(tmp_path / "g")).write_nodes(nodes)
    store = RagStore(spark, str(tmp_path / "g"), "w")
    store.write_nodes(nodes)
    store.write_edges(e, low=(None, 4, None))
    assert store.edges().isEmpty()
    store.write_edges(e, high=(None, 4, None))
    store.write_edges(e, high=(None, 4, None))
    assert [(r.u, r.v) for r in store.edges().collect()] == [(3, 9)]


def test_ids_are_checked(spark):
    df = spark.createDataFrame([("9223372036854775807",)], "label string")
    assert checked_ids(df, "label").first().label == 2**63 - 1
    with pytest.raises(Exception, match="out of range"):
        checked_ids(spark.createDataFrame([("9223372036854775808",)], "label string"), "label").collect()
