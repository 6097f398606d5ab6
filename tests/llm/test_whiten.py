import numpy as np
import pytest

from plumbline.llm import whiten

COLUMNS = "vec_id long, embedding array<float>, label int, n string, component string, vector string"


@pytest.fixture(scope="module")
def frame(spark):
    def make(pairs, partitions=3):
        rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "n", "c", "v") for i, v in pairs]
        return spark.createDataFrame(rows, COLUMNS).repartition(partitions)

    return make


def dense(vectors):
    """Integers, centred integers and the eigenvalues and vectors of their covariance, largest first."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100000
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1], vectors[:, ::-1]


def check(found, ids, vectors, components=8):
    x, centred, values, axes = dense(vectors)
    n, total = len(x), x.sum(axis=0)
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    known = found.drop_duplicates("vec_id").set_index("vec_id").loc[ids]
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    assert known.deviation.tolist() == exact and (found.n == n).all()
    explained = found.groupby("component").explained.first().to_numpy()
    assert len(explained) == components
    assert np.allclose(explained, values[:components] / values.sum(), rtol=1e-10)
    for k in range(components):
        expected = centred @ axes[:, k] / np.sqrt(values[k])
        sign = np.sign(expected @ wide[:, k])
        assert np.abs(sign * wide[:, k] - expected).max() < 1e-7
    error = found.identity_error.unique()
    assert len(error) == 1 and error[0] < 1e-8
    assert np.allclose(wide.T @ wide / n, np.eye(components), atol=1e-8)


def test_random_vectors_equal_a_dense_decomposition(frame):
    draw = np.random.default_rng(1)
    vectors = (draw.normal(size=(400, 24)) * np.linspace(0.05, 1, 24)).astype(np.float32)
    found = whiten.whiten(frame(enumerate(vectors.tolist()))).toPandas()
    assert len(found) == 400 * 8
    check(found, list(range(400)), vectors)


def test_steep_spectrum_stops_early_and_is_still_exact(spark, frame):
    draw = np.random.default_rng(2)
    turn = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    vectors = ((draw.normal(size=(600, 40)) * 4.0 ** -np.arange(40).clip(max=9) * 900) @ turn).astype(np.float32)
    blocks = whiten.integers(frame(enumerate(vectors.tolist())))
    model = whiten.fit(blocks)
    assert model.steps < 40
    check(whiten.apply(blocks, model).toPandas(), list(range(600)), vectors)


def test_equal_eigenvalues_are_all_found(frame):
    """Signed unit vectors: every direction has the same variance, which one start vector cannot show."""
    vectors = [s * row for s in (1, -1) for row in np.eye(12)]
    found = whiten.whiten(frame(enumerate(np.array(vectors).tolist()))).toPandas()
    explained = found.groupby("component").explained.first()
    assert len(explained) == 8 and np.allclose(explained, 1 / 12, rtol=1e-9)
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide.T @ wide / 24, np.eye(8), atol=1e-9)


def test_two_equal_leading_eigenvalues(frame):
    spread = np.array([5, 5, 4, 3, 2, 1.5, 1, 0.75, 0.5, 0.25])
    vectors = [s * a * row for s in (1, -1) for a, row in zip(spread, np.eye(10), strict=True)]
    found = whiten.whiten(frame(enumerate(np.array(vectors).tolist()))).toPandas()
    explained = found.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, (spread**2 / (spread**2).sum())[:8], rtol=1e-9)


def test_rows_that_take_no_part(frame):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(50, 5)).astype(np.float32)
    odd = [(100, None), (101, []), (102, [1, 2, 3, 4, None]), (103, [1, 2, 3, 4, float("nan")]), (104, [1, 2, 3, 4, float("inf")]), (105, [1, 2])]
    found = whiten.whiten(frame(list(enumerate(vectors.tolist())) + odd)).toPandas()
    assert sorted(found.vec_id.unique()) == list(range(50))
    check(found, list(range(50)), vectors, 5)


def test_null_and_repeated_ids_and_fewer_directions(frame):
    pairs = [(None, [0, 0, 1]), (1, [2, 0, 1]), (1, [2, 0, 1]), (2, [4, 0, 1])]
    found = whiten.whiten(frame(pairs)).toPandas()
    assert len(found) == 4 and found.vec_id.isna().sum() == 1 and (found.component == 1).all()
    assert np.allclose(found.explained, 1) and np.allclose((found.whitened**2).mean(), 1)


def test_no_variance_and_empty_tables_give_no_rows(frame):
    assert whiten.whiten(frame([])).count() == 0
    assert whiten.whiten(frame([(1, [1, 2])])).count() == 0
    assert whiten.whiten(frame([(1, None)])).count() == 0
    assert whiten.whiten(frame([(i, [3, 4]) for i in range(5)])).count() == 0


def test_deviation_beyond_64_bits_is_null():
    x = np.array([[2**41, 0], [1, 1]], np.int64)
    sums = np.array([2**41 + 1, 1], dtype=object)
    found = whiten._deviations(x, 2, sums)
    assert found == [None, None]
    assert whiten._deviations(np.array([[3, 5]]), 2, np.array([4, 6], dtype=object)) == [4 + 16]
