"""Batches through nodes, and block functions of several inputs, against plain models."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi
from voxelspark.operators import batch as B
from voxelspark.operators import shape as SH
from voxelspark.operators.voxels import crop
from voxelspark.streaming.blocks import BlockInput, map_blocks

BOX = Roi((0, 5, 6), (3, 4, 5))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A labelled volume as Parquet."""
    rng = np.random.default_rng(5)
    rows = [(z, y, x, int(rng.integers(0, 4)), float(rng.random())) for z, y, x in np.ndindex(3, 16, 18)]
    path = str(tmp_path_factory.mktemp("volume") / "v")
    spark.createDataFrame(rows, "z int, y int, x int, label long, raw double").write.parquet(path)
    return spark.read.parquet(path)


def test_context_is_asked_for_and_pushed_down(spark, stored, rows):
    """A box through nodes has the values of the whole volume's run; the scan reads the grown box alone."""
    nodes = [B.grown_boundary("labels", steps=1), B.AddDescriptors("labels", "descriptors", (1, 1, 1)), B.added_affinities("labels", "affinities")]
    request = {"descriptors": BOX, "affinities": BOX}
    asked = B.requests(nodes, request)
    assert asked[2]["labels"] == BOX.grow((1, 1, 1), (1, 1, 1)) and asked[0]["labels"] == BOX.grow((4, 4, 4), (4, 4, 4)) and set(asked[0]) == {"labels"}
    labels = stored.select("z", "y", "x", "label")
    got = B.batch({"labels": labels}, nodes, request)
    grown = nodes[0].fn(labels)
    assert rows(got["descriptors"]) == pytest.approx(rows(crop(SH.shape_descriptors(grown, (1, 1, 1)), BOX)))
    assert rows(got["affinities"]) == rows(crop(nodes[2].fn(grown), BOX)) and got["affinities"].count() == 60
    one = B.batch({"labels": labels}, nodes[1:2], {"descriptors": BOX})["descriptors"]
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert all(f"{test}({a},{at})" in plan for a, low, high in (("y", 2, 12), ("x", 3, 14)) for test, at in (("GreaterThanOrEqual", low), ("LessThan", high)))


def test_own_nodes_and_missing_volumes(stored):
    class Threshold(B.Node):
        def prepare(self, request):
            return B.asked_too({k: v for k, v in request.items() if k != "mask"}, "raw", request["mask"])

        def process(self, batch, request):
            return batch | {"mask": batch["raw"].select("z", "y", "x", (F.col("raw") > 0.5).alias("mask"))}

    raw = stored.select("z", "y", "x", "raw")
    wide = BOX.grow((0, 1, 1), (0, 1, 1))
    found = B.batch({"raw": raw}, [Threshold()], {"mask": BOX, "raw": wide})
    assert found["mask"].count() == 60 and found["raw"].count() == 3 * 6 * 7 and set(found) == {"mask", "raw"}
    assert B.batch({"raw": raw}, [], {"raw": Roi((0, 0, 0), (0, 5, 5))})["raw"].isEmpty()
    with pytest.raises(KeyError):
        B.batch({}, [Threshold()], {"mask": BOX})
    with pytest.raises(KeyError):
        B.batch({"raw": raw}, [B.Node()], {"raw": BOX, "other": BOX})


def test_inputs_of_several_voxel_sizes(spark):
    """Sums of what each block reads of a fine and a coarse volume; positions below 0, blocks without one input, bytes."""
    rng = np.random.default_rng(6)
    fine = [(0, int(y), int(x), int(v)) for y, x, v in {(a, b): (a, b, v) for a, b, v in rng.integers(-9, 12, (90, 3)).tolist()}.values()]
    coarse = [(0, y, x, 10 * y + x) for y in range(-2, 2) for x in range(0, 3)]
    frame = lambda r, c: spark.createDataFrame([*r, (None, 1, 1, 5)], f"z int, y int, x int, {c} long")
    inputs = {"fine": BlockInput(frame(fine, "v"), (0, 2, 1)), "coarse": BlockInput(frame(coarse, "w"), (0, 4, 4), (1, 4, 4))}

    def fn(read, box):
        v, w = read["fine"].column("v"), read["coarse"].column("w")
        assert box.shape == (1, 6, 5)
        n = len(v)
        total = int(np.sum(w.to_numpy())) if len(w) else -1
        t = read["fine"].drop_columns(["owned"]).append_column("near", pa.array([int(np.sum(v.to_numpy()))] * n, pa.int64()))
        return t.append_column("coarse", pa.array([total] * n, pa.int64())).append_column("share", pa.array(np.linspace(0, 2, n)))

    got = {(r.y, r.x): r for r in map_blocks(inputs, fn, "near long, coarse long, share double", (1, 6, 5), as_bytes=["share"]).collect()}
    assert len(got) == len(fine) and all(0 <= r.share <= 255 for r in got.values())
    for _, y, x, _ in fine:
        by, bx = y // 6 * 6, x // 5 * 5
        near = sum(v for _, a, b, v in fine if by - 2 <= a < by + 8 and bx - 1 <= b < bx + 6)
        far = [w for _, a, b, w in coarse if by - 4 <= 4 * a < by + 10 and bx - 4 <= 4 * b < bx + 9]
        assert (got[y, x].near, got[y, x].coarse) == (near, sum(far) if far else -1)
    with pytest.raises(ValueError):
        map_blocks({}, fn, "near long", (1, 6, 5))
