import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import block_knn

SCHEMA = "vec_id long, embedding array<float>, query_id string, block string, tile string"


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    out = set()
    for q in usable:
        if q % 10:
            continue
        near = {(float(np.sqrt(((a - b) ** 2).sum())), i) for a in usable[q] for i in usable if i != q for b in usable[i] if len(a) == len(b)}
        out |= {(q, rank, i, d) for rank, (d, i) in enumerate(sorted(near)[:k], 1)}
    return out


def test_equal_to_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (centres[i % 5] + rng.normal(size=16) * 0.2).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 340)]  # ties
    rows += [(3, rows[3][1]), (400, None), (410, [0.0] * 16), (420, [float("nan")] + [1.0] * 15), (430, [])]
    rows += [(440, [None] + [1.0] * 15), (None, [1.0] * 16), (450, [float("inf")] * 16), (460, [1.0, 2.0]), (461, [1.0, 3.0])]
    table = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(5)
    found = block_knn.nearest(table, F.col("vec_id") % 10 == 0, tile=32).collect()
    got = {(r.query_id, r.rank, r.vec_id) for r in found}
    expected = brute(rows, 10)
    assert got == {e[:3] for e in expected} and len(found) == len(expected)
    scores = {e[:3]: e[3] for e in expected}
    assert all(abs(scores[r.query_id, r.rank, r.vec_id] - r.score) < 1e-12 for r in found)


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 24)) * rng.uniform(0.01, 100, size=(50, 1))
    codes, scale, error = block_knn.quantise(x)
    gap = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    assert np.allclose(gap, error) and (np.abs(x - codes * scale[:, None]) <= scale[:, None] / 2 + 1e-12).all()


def test_no_rows(spark):
    assert block_knn.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
