import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm import op01_norm_topk as T


def brute(rows, k, mod):
    """Contract by all pairs; rows: (vec_id, vector)."""
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * float(np.float32(x))) for x in v]
            fine[i] = min(fine.get(i, w), w)
    out = []
    for q, v in fine.items():
        if q % mod == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in fine.items() if c != q and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best[:k])]
    return sorted(out)


def run(spark, rows, k=5, mod=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).withColumn("score", F.lit(1))
    return sorted(map(tuple, T.norm_topk(T.integer_vectors(df), F.col("vec_id") % mod == 0, k).collect()))


def test_lengths_ties_and_signs(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP_ROWS", 40)
    monkeypatch.setattr(T, "QUERY_ROWS", 25)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(260):
        v = rng.normal(size=6) * 10 ** rng.uniform(-2, 1.5)
        if i % 5 == 0:
            v = np.full(6, 0.5)
        if i % 17 == 0:
            v = np.zeros(6)
        rows.append((i, v.astype(np.float32).tolist()))
    assert run(spark, rows) == brute(rows, 5, 3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (6, [inf, 0.0]), (9, [-1.0, -2.0]), (12, [1.0, 2.0]), (12, [1.0, 2.0]), (None, [5.0, 5.0]), (15, [1.0]), (18, [2.0]), (21, []), (24, [1e12, 3.0])]
    assert run(spark, rows) == brute(rows, 5, 3)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(3, [1.0])]) == []


@pytest.mark.parametrize("cosine", [0.0, 0.5, 0.9, 0.99, 1.0])
def test_coordinate_intervals_hold_every_vector_within_the_cosine(cosine):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 3))
    x = np.vstack([x, np.eye(3), -np.eye(3)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for q in x[::400]:
        low, high = T._interval(cosine, q)
        near = x[x @ q >= cosine]
        assert ((near >= low) & (near <= high)).all()


def test_high_thresholds_use_coordinates_and_stay_exact():
    rng = np.random.default_rng(8)
    c = rng.integers(-30, 30, (500, 8))
    q = c[::25].copy()
    floor = np.array([float(np.sort(c @ v)[-3]) for v in q])
    ids = np.arange(500)
    got = sorted(zip(*(x.tolist() for x in T.search_group(ids[::25], q, floor, ids, c, 3)), strict=True))
    want = []
    for i, v, f in zip(ids[::25], q, floor, strict=True):
        best = sorted((-int(v @ w), j) for j, w in enumerate(c) if j != i and v @ w >= f)[:3]
        want += [(int(i), j, -s) for s, j in best]
    assert got == sorted(want)
