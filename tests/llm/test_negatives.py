"""Hard negatives against plain Python, with few and many directions, small blocks, ties and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import op13_negatives as T13

SCHEMA = "vec_id long, embedding array<double>, label int"


def model(rows, positives=5, negatives=10, low=30, high=90, every=10):
    ok = [(k, [math.floor(256 * x) for x in v], y) for k, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    big, out = 1 << 63, []
    for n, (a, va, ya) in enumerate(ok):
        if a is None or a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(va, v, strict=True)), big if k is None else k, y) for m, (k, v, y) in enumerate(ok) if m != n and len(v) == len(va)]
        for s, k, _ in sorted(x for x in scored if x[2] == ya)[:positives]:
            inside = sorted((t, j) for t, j, y in scored if y != ya and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a, None if k == big else k, r, None if j == big else j, -s, -t) for r, (t, j) in enumerate(inside, 1)]
    return out


def odd_rows(n=300, dim=6):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(5, dim))
    rows = [(k, (middle[k % 5] + rng.normal(size=dim) * 0.4).round(1).tolist(), int(rng.integers(0, 4))) for k in range(n)]
    rows += [(n + k, rows[3][1], k % 3) for k in range(40)]  # one vector many times
    rows += [(1000, None, 1), (1010, [1.0] * dim, None), (1020, [None] + [1.0] * (dim - 1), 1), (1030, [float("nan")] * dim, 1), (1040, [float("inf")] * dim, 1)]
    rows += [(1050, [0.0] * dim, 1), (1060, [1.0, 2.0], 1), (1061, [1.0, 1.0], 1), (1062, [0.5, 0.5], 2), (1070, [], 1), (1071, [], 2), (None, rows[0][1], 1), (None, rows[0][1], 2), rows[20], rows[20], rows[30]]
    return rows


@pytest.mark.parametrize("how", [{}, {"count": 3, "block_rows": 40, "block_anchors": 7}, {"count": 0, "block_rows": 90}, {"count": 30, "positives": 2, "negatives": 3}, {"low": -50, "high": 100}])
def test_against_plain_python(spark, how):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("q", "nth", "norm", "angles", "_r", "_a")})
    got = T13.hard_negatives(T13.quantised(docs), F.col("vec_id") % 10 == 0, **how).collect()
    plain = {k: v for k, v in how.items() if k in ("positives", "negatives", "low", "high")}
    assert sorted(map(tuple, got), key=repr) == sorted(model(rows, **plain), key=repr) and got


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T13.hard_negatives(T13.quantised(none), F.col("vec_id") % 10 == 0).isEmpty()
    alone = spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 2)], SCHEMA)
    assert T13.hard_negatives(T13.quantised(alone), F.col("vec_id") % 10 == 0).isEmpty()


def test_too_large(spark):
    rows = spark.createDataFrame([(10, [1e12], 1)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        T13.hard_negatives(T13.quantised(rows), F.col("vec_id") % 10 == 0).collect()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(20, 32)) * 3
    q = np.floor(256 * (middle[rng.integers(0, 20, 800)] + rng.normal(size=(800, 32)) * 0.2)).astype(np.int64)
    to = T13.directions(q[:200].astype(float), 24)
    norm = np.linalg.norm(q.astype(float), axis=1)
    angles = np.arccos(np.clip(q @ to.T / norm[:, None], -1, 1)).astype(np.float32)
    lower, upper = T13.bounds(norm, angles, norm, angles)
    exact = q @ q.T
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (upper >= T13.kth_largest(lower, 10)[:, None]).mean() < 0.15  # most rows need no score
