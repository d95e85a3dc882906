"""What large tables must not do: be broadcast by their file's size, meet in one task, cost a step of Python an object."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import blocks as BL
from voxelspark.operators import voxels as V
from voxelspark.operators.voxels import gaussian


def test_kernel_join_sends_no_volume_to_the_driver(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 0, 0, 0, 6), (1, 0, 1, 0, 7), (2, 0, 0, 1, 8), (None, 0, 1, 1, 9), (1, 0, None, 0, 3), (1, 0, 200, 70, 4), (1, 0, 201, 70, 2)], "label long, z int, y int, x int, raw int")
    v.write.parquet(str(tmp_path / "v"))
    v, kernel = spark.read.parquet(str(tmp_path / "v")), V.ball((0, 1, 1))
    found = V.kernel_join(v, v, kernel)
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    held = [r for r in v.collect() if r.label is not None and r.y is not None]
    want = sorted((q.y - p.y, q.x - p.x, p.label, p.raw, q.raw) for p in held for q in held if p.label == q.label and abs(q.y - p.y) + abs(q.x - p.x) <= 1)
    assert sorted((r.dy, r.dx, r.label, r.raw, r.source_raw) for r in found.collect()) == want
    assert found.columns == ["label", "z", "y", "x", "raw", "dz", "dy", "dx", "w", "source_raw"]


def test_moments_of_many_small_objects_at_once():
    rng = np.random.default_rng(5)
    place = rng.integers(0, 12, (3, 300))
    number = np.sort(rng.integers(0, 90, 300))
    kernel, terms = BL.Kernel([gaussian(1.0)] * 3), [(), (0,), (1, 2)]
    first, count = np.searchsorted(number, number), np.searchsorted(number, number, "right") - np.searchsorted(number, number)
    found = BL.moments_of_near(place, place, first, count, kernel, terms)
    for k in range(90):
        own = place[:, number == k]
        assert np.allclose(found[:, number == k], BL.moments_of_pairs(own, own, kernel, terms))


def test_distance_along_long_lines_piece_by_piece(spark):
    rng = np.random.default_rng(3)
    # long gaps without a value, lines without any, and places far apart
    at = {(0, int(y), int(x)): (int(f) if k else None) for y, x, f, k in zip(rng.integers(-40, 90, 600), rng.integers(0, 70, 600), rng.integers(0, 400, 600), rng.random(600) < 0.25, strict=True)}
    at |= {(9, y, 3): None for y in range(0, 60, 7)} | {(9, 5000, 3): 2, (9, 1, 4): None}
    df = spark.createDataFrame([(*p, f) for p, f in at.items()], "z int, y int, x int, d2 long")
    for length in (4, 16, 1024):
        found = {(r.z, r.y, r.x): r.d2 for r in BL.nearest_along(df, "y", "d2", length).collect()}
        want = {(z, y, x): min(((y - q) ** 2 + f for (c, q, e), f in at.items() if (c, e) == (z, x) and f is not None), default=None) for z, y, x in at}
        assert found == want


def test_tables_that_compress_well_are_not_broadcast_as_small(spark, tmp_path):
    from voxelspark.plans.iterate import Scratch

    ids = Scratch(spark, "packed").settle(spark.range(3_000_000).select("id", (F.col("id") * 2).alias("to"), F.lit(0).alias("z")))
    plan = spark.range(100_000_000).join(ids, "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan


def test_edge_scores_copy_no_voxel_for_an_edge(spark, monkeypatch):
    """Scores of edges by sums that add up, in small blocks and big ones, are those of descriptors of the merged labels; voxels at one
    place, without a target, and ends that are apart or unknown."""
    from voxelspark.operators import agglomerate as A
    from voxelspark.operators import shape as SH

    rng = np.random.default_rng(8)
    lab = rng.integers(1, 4, (2, 4, 5)).repeat(4, axis=1).repeat(5, axis=2) + 10 * np.arange(2)[:, None, None]
    lab[:, 2:5, 3:9], lab[0, 9:, :8] = rng.integers(0, 4, (2, 3, 6)), 20
    places = [(int(z), int(y), int(x)) for z, y, x in np.argwhere(lab)]
    v = spark.createDataFrame([(*p, int(lab[p])) for p in places] + [(0, 0, 1, 21), (0, 500, 0, 22), (1, 500, 0, 23)], "z int, y int, x int, label long")
    u = spark.createDataFrame([(*p, p[1] // 7 + 1) for p in places if p[2] % 4] + [(0, 500, 0, 1)], "z int, y int, x int, label long")
    labels = sorted({r.label for r in v.select("label").collect()})
    edges = spark.createDataFrame([(a, b) for a in labels for b in labels if a < b] + [(1, 99)], "u long, v long")
    plain, called = SH.shape_descriptors, []
    for dims in (2, 3):
        sigma, target, channels = (1.0, 1.5, 1.0), SH.shape_descriptors(u, (1.0, 1.0, 1.0), dims=dims), SH.channel_names(dims)
        score = lambda df: {r.id: r.score for r in A.node_descriptor_scores(plain(df, sigma, (1, 1, 2), dims=dims), target, channels).collect()}  # noqa: B023, E731
        alone, want = score(v), {}
        for a, b in [(1, 2), (11, 20), (2, 12), (1, 21), (3, 22), (20, 22)]:
            want[a, b] = score(v.where(F.col("label").isin(a, b)).withColumn("label", F.lit(1).cast("long")))[1] - alone[a] - alone[b]
        monkeypatch.setattr(SH, "shape_descriptors", lambda *a, **k: called.append(1) or plain(*a, **k))
        for block in ((32, 128, 128), (1, 5, 4)):
            monkeypatch.setattr(SH, "BLOCK", block)
            got = {(r.u, r.v): r.score for r in A.edge_descriptor_scores(v, edges, target, sigma, (1, 1, 2), dims).collect()}
            assert all(abs(got[e] - s) < 1e-9 for e, s in want.items()) and got[20, 22] == 0
            assert set(got) == {(a, b) for a in alone for b in alone if a < b} and 23 not in alone
        monkeypatch.setattr(SH, "shape_descriptors", plain)
    assert not called


@pytest.mark.parametrize("cost", [0, 1e9])
def test_moments_around_places_of_other_objects(monkeypatch, cost):
    """Near pairs, lines, offsets and all objects at once agree, also where a probe is outside the object."""
    monkeypatch.setattr(BL, "MOMENT_NS", cost)
    rng = np.random.default_rng(6)
    at = np.stack([g.ravel() for g in np.meshgrid(np.arange(3), np.arange(60), np.arange(60), indexing="ij")])
    label = (at[1] // 30) * 2 + (at[2] > 5)
    probe, other = rng.integers(-4, 66, (3, 500)), rng.integers(0, 5, 500)  # no voxel is of object 4
    for kernel in (BL.Kernel([gaussian(0.5), gaussian(2.0), gaussian(1.5)]), BL.Kernel(ball=V.ball((1, 2, 2)))):
        terms = [(), (1,), (0, 2)]
        found = BL.moments_of_objects(at, label, probe, other, kernel, terms)
        for k in range(5):
            own, asked = at[:, label == k], probe[:, other == k]
            n = asked.shape[1]
            assert np.allclose(found[:, other == k], BL.moments_of_near(own, asked, np.zeros(n, np.int64), np.full(n, own.shape[1]), kernel, terms))


def test_samples_share_blocks_while_they_are_worked_on(spark, monkeypatch):
    from voxelspark.operators import samples as SM

    seen, plain = [], SM.grow_boundary
    monkeypatch.setattr(SM, "grow_boundary", lambda v, **how: seen.append(v) or plain(v, **how))
    v = spark.range(40 * 20).select(F.lit(0).alias("z"), F.expr("cast(id div 20 as int) y"), F.expr("cast(id % 20 as int) x"), F.expr("id div 7 + 1 as label"), F.col("id").cast("double").alias("raw"))
    got = SM.training_samples(v, (1, 1, 1), (1, 4, 4), 40, 4, dims=2, seed=1).select("sample", "z", "y", "x").collect()
    assert len(got) == 40 * 16 and {(r.z, r.y, r.x) for r in got} == {(0, y, x) for y in range(4) for x in range(4)}
    assert seen[0].select(F.expr("z div 32"), F.expr("y div 128"), F.expr("x div 128")).distinct().count() <= 8  # 20 before


def test_marked_edges_are_made_once(spark):
    from voxelspark.operators import agglomerate as A

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "u long, v long").mapInArrow(count, "u long, v long")
    history = spark.createDataFrame([(1, 2, 1, 0.1, 0), (1, 3, 1, 0.2, 1)], "a long, b long, c long, score double, round int")
    got = {(r.u, r.v): (r.merge_score, r.agglomerated) for r in A.mark_edges(edges, A.merge_tree(history)).collect()}
    assert got == {(1, 2): (0.1, True), (2, 3): (0.2, True), (1, 4): (None, True)} and made.value == 3


def test_region_graph_in_tasks_that_follow_the_voxels(spark, monkeypatch):
    from voxelspark.operators import rag as G

    rng = np.random.default_rng(4)
    lab = rng.integers(0, 5, (3, 9, 8))
    v = spark.createDataFrame([(*map(int, p), int(lab[tuple(p)])) for p in np.argwhere(lab >= 0)] + [(0, None, 0, 2), (1, 300, 0, 7), (1, 301, 0, 6)], "z int, y int, x int, label long")
    at = {tuple(map(int, p)): int(lab[tuple(p)]) for p in np.argwhere(lab)} | {(1, 300, 0): 7, (1, 301, 0): 6}
    want = {}
    for p, a in at.items():
        for o in V.HALF_2:
            if (b := at.get(tuple(i + d for i, d in zip(p, o, strict=True)), a)) != a:
                want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + 1
    for rows, block in ((1_000_000, (32, 128, 128)), (10, (2, 3, 4))):
        monkeypatch.setattr(BL, "ROWS", rows)
        monkeypatch.setattr(BL, "BLOCK", block)
        edges = G.build_rag(v)
        assert {(r.u, r.v): r.n for r in edges.collect()} == want
        assert ("REPARTITION_BY_NUM" in edges._jdf.queryExecution().toString()) == (rows == 10)


def test_voxel_components_meet_at_block_sides_alone(spark, monkeypatch):
    from voxelspark.operators import labels as L

    rng = np.random.default_rng(9)
    a = rng.integers(0, 3, (4, 13, 11))
    a[:, :, 3], a[1, 6] = 1, 2
    v = spark.createDataFrame([(*map(int, p), int(a[tuple(p)]), float(p[2])) for p in np.argwhere(a >= 0)] + [(0, None, 0, 1, 0.5)], "z int, y int, x int, value long, more double")
    links, plain = [], L.connected_components
    monkeypatch.setattr(L, "connected_components", lambda e, **how: links.append(e.count()) or plain(e, **how))
    for full in (False, True):
        offsets = [o for o in np.ndindex(3, 3, 3) if 0 < (s := sum(abs(c - 1) for c in o)) and (full or s == 1)]
        root = {tuple(map(int, p)): (int(p[0]) * 13 + int(p[1])) * 11 + int(p[2]) + 1 for p in np.argwhere(a)}
        again = True
        while again:
            near = {p: min(root[q] for o in [(1, 1, 1), *offsets] if (q := tuple(c + d - 1 for c, d in zip(p, o, strict=True))) in root and a[q] == a[p]) for p in root}
            again, root = near != root, near
        for block in ((32, 128, 128), (2, 4, 5)):
            monkeypatch.setattr(BL, "BLOCK", block)
            got = L.label_components(v, "value", a.shape, full)
            assert got.columns == ["z", "y", "x", "value", "more", "component"]
            assert {(r.z, r.y, r.x): r.component for r in got.where("y is not null").collect()} == root
            assert [r.component for r in got.where("y is null").collect()] == [None]
    assert links[0] == links[2] == 0 < links[1] < len(root)
