"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of centred vectors.

Vectors stand in blocks of rows in the shared folder. With X the centred rows, each step
extends orthonormal bases U and V so that X V = U B with B upper bidiagonal. A step is one
pass: a task multiplies its rows, p = X w, at once multiplies back, X'p, and takes p's
products with all earlier u. Sums over the tasks, one number for each dimension and step, come
to the driver; no vector as long as the table does. That is possible as every u is X times
a known vector, so a task finds its part of U again from these vectors.

Both sides are fully orthogonalised, U by a second pass where the first left too much. A
small singular value decomposition of B gives components and deviations. Steps go on until
the leading residuals vanish and what is left of the total variance is less than the last
wanted eigenvalue, so that no direction, not even one of an equal eigenvalue, is hidden from
the start vector; at the latest after as many steps as there are dimensions. When a step
finds an invariant subspace, the next starts from a new direction orthogonal to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle

COMPONENTS = 8
BLOCK = 4096
SCALE, SHIFT = 1024, 100_000
_BLOCKS = "ids binary, known binary, x binary"
_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """``components`` (rows, unit vectors), their eigenvalues, the mean and the number of the fit list."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int


def finite(vector: Column) -> Column:
    """Not null or empty, and every entry a finite number."""
    every = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(every & (F.size(vector) > 0), F.lit(False))


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Blocks of up to 4096 rows: ids and ``floor(1024 * c) + 100000`` as 64-bit integers, settled.

    Left out are vectors that are null or empty or hold a null or non-finite entry, entries
    beyond 2**40, and vectors of another width than most (the larger width if two are as frequent).
    """
    vector = rows[vector_col].cast("array<double>")
    chosen = rows.select(rows[id_col].cast("long").alias("id"), vector.alias("vector"))
    chosen = chosen.filter(finite(F.col("vector")) & F.forall("vector", lambda c: F.abs(c) < float(2**40)))
    widths = chosen.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), F.desc("width")).limit(1).select("width").scalar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                ids = some.column("id")
                values = some.column("vector").flatten().to_numpy(zero_copy_only=False)
                x = np.floor(SCALE * values).astype(np.int64) + SHIFT
                known = np.asarray(pc.is_valid(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([np.asarray(pc.fill_null(ids, 0)).tobytes()], pa.binary()),
                        pa.array([known.tobytes()], pa.binary()),
                        pa.array([x.tobytes()], pa.binary()),
                    ],
                    names=["ids", "known", "x"],
                )

    found = chosen.filter(F.size("vector") == common).mapInArrow(run, _BLOCKS)
    return settle(found, "integers")


def _matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for known, x in zip(batch.column("known").to_pylist(), batch.column("x").to_pylist(), strict=True):
        yield np.frombuffer(x, np.int64).reshape(len(known), -1)


def _sums(blocks: DataFrame, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over all blocks of a vector of doubles; a task sends one number for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _matrices(batch):
                one = of_block(x)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    found = blocks.select("known", "x").mapInArrow(run, "at long, value double")
    rows = found.groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    if not len(rows):
        return None
    out = np.empty(len(rows))
    out[rows["at"].to_numpy()] = rows["value"].to_numpy()
    return out


def _count(blocks: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and each dimension's exact sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _matrices(batch):
                total = np.concatenate(([len(x)], x.sum(axis=0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    found = blocks.select("known", "x").mapInArrow(run, "at long, value long").groupBy("at")
    rows = found.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).orderBy("at").collect()
    numbers = [int(r["value"]) for r in rows]
    return (numbers[0], numbers[1:]) if numbers else (0, [])


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The vector without its parts along the basis' rows; twice is enough."""
    for _ in range(2):
        vector = vector - basis.T @ (basis @ vector)
    return vector


class _Bidiagonal:
    """The bases and B as far as the steps have come.

    ``w``: the vectors with u = X w. ``back``: the products X'u, which are known from the passes.
    """

    def __init__(self, blocks: DataFrame, mean: np.ndarray) -> None:
        self.blocks, self.mean, d = blocks, mean, len(mean)
        self.v, self.w, self.back = np.empty((0, d)), np.empty((0, d)), np.empty((0, d))
        self.alpha: list[float] = []
        self.beta: list[float] = []  # beta[j] couples u_j with v_(j+1)

    def products(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """X'Xw, the products of Xw with every u, and the square of its length, in one pass."""
        mean, others, d = self.mean, self.w.T.copy(), len(self.mean)

        def of_block(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            p = centred @ w
            return np.concatenate((p @ centred, p @ (centred @ others), [p @ p]))

        total = _sums(self.blocks, of_block)
        return total[:d], total[d:-1], float(total[-1])

    def step(self, v: np.ndarray, beta: float, scale: float) -> np.ndarray:
        """Add v and the u that belongs to it; the result is what follows as beta times the next v."""
        w = v - beta * self.w[-1] if len(self.w) and beta else v
        for _ in range(3):
            back, along, square = self.products(w)
            w = w - along @ self.w
            back = back - along @ self.back
            rest = max(square - float(along @ along), 0.0)
            if rest > 0.5 * square or rest <= (scale * _EPS) ** 2:
                break
        alpha = float(np.sqrt(rest))
        self.v = np.vstack((self.v, v))
        if alpha <= scale * _EPS * 16:  # v is in the null space of X
            self.alpha.append(0.0)
            self.w, self.back = np.vstack((self.w, 0 * w)), np.vstack((self.back, 0 * w))
            return 0 * v
        self.alpha.append(alpha)
        self.w, self.back = np.vstack((self.w, w / alpha)), np.vstack((self.back, back / alpha))
        return _orthogonal(back / alpha - alpha * v, self.v)

    def decomposed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.diag(self.alpha) + np.diag(self.beta[: len(self.alpha) - 1], 1)
        return np.linalg.svd(b)


def fit(blocks: DataFrame, components: int = COMPONENTS, seed: int = 11) -> Whitening | None:
    """The leading components of settled blocks; None without rows.

    Directions without variance (beyond rounding) are no components, so there can be fewer.
    """
    n, sums = _count(blocks)
    if not n:
        return None
    exact = np.array(sums, dtype=object)
    mean, d = np.array([s / n for s in sums]), len(sums)
    total = float(_sums(blocks, lambda x: np.array([((x - mean) ** 2).sum()]))[0])
    scale = float(np.sqrt(total))
    if not total:
        return Whitening(n, exact, np.empty((0, d)), np.empty(0), 0.0, 0)
    draw = np.random.default_rng(seed)
    run = _Bidiagonal(blocks, mean)
    v, beta = draw.normal(size=d), 0.0
    v /= np.linalg.norm(v)
    while True:
        after = run.step(v, beta, scale)
        length = float(np.linalg.norm(after))
        left, values, right = run.decomposed()
        steps = len(run.alpha)
        if steps == d:
            break
        beta = length if length > scale * _EPS * 16 else 0.0
        wanted = min(components, steps)
        residual = np.abs(beta * left[-1, :wanted]).max()
        missing = total - float((values**2).sum()) - beta * beta
        if steps > components and residual <= 4 * _EPS * values[0] and missing < values[components - 1] ** 2 * 0.5:
            break
        if beta:
            v = after / length
        else:
            v = _orthogonal(draw.normal(size=d), run.v)
        v = _orthogonal(v / np.linalg.norm(v), run.v)
        v /= np.linalg.norm(v)
        run.beta.append(beta)
    found = values > max(scale * np.sqrt(_EPS), 0.0) * 1e-6
    keep = np.flatnonzero(found)[:components]
    return Whitening(n, exact, right[keep] @ run.v, values[keep] ** 2 / n, total / n, steps)


def _identity_error(blocks: DataFrame, model: Whitening, mean: np.ndarray) -> float:
    """The largest entry of the whitened rows' covariance minus the identity; their means are zero up to rounding
    and are taken off all the same."""
    k, axes = len(model.eigenvalues), model.components.T / np.sqrt(model.eigenvalues)

    def of_block(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ axes
        return np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))

    total = _sums(blocks, of_block) / model.n
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """sum (n x - S)^2 in exact integers; None beyond 64 bits."""
    bound = n * max(int(np.abs(x).max()), 1) + max(abs(s) for s in sums.tolist())
    if bound < 2**62:
        off = n * x - sums.astype(np.int64)
        if x.shape[1] * int(np.abs(off).max()) ** 2 < 2**63:
            return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - sums
    return [value if value < 2**63 else None for value in (off * off).sum(axis=1).tolist()]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(blocks: DataFrame, model: Whitening | None) -> DataFrame:
    """One row for each vector and component (see ``whiten``)."""
    if model is None or not len(model.eigenvalues):
        return blocks.sparkSession.createDataFrame([], _OUT)
    mean = np.array([s / model.n for s in model.sums.tolist()])
    error = _identity_error(blocks, model, mean)
    axes, explained, k = model.components.T / np.sqrt(model.eigenvalues), model.eigenvalues / model.trace, len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, x in zip(batch.column("ids").to_pylist(), batch.column("known").to_pylist(), _matrices(batch), strict=True):
                rows = len(x)
                deviation = pa.array(_deviations(x, model.n, model.sums), pa.int64())
                named = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        named.take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, model.n)),
                        deviation.take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(((x - mean) @ axes).ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.mapInArrow(run, _OUT)


def whiten(
    rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector.

    Every vector that is not null, is not empty and holds finite entries only is in the fit
    list and in the result, under a null id too and as often as it is repeated; ``integers``
    says which widths are left out. ``deviation`` is exact, null beyond 64 bits. Components
    without variance are not returned, so vectors that are all alike, and empty tables, give
    no rows. Equal eigenvalues have some orthonormal pair of components. Other columns are not looked at.
    """
    blocks = integers(rows, id_col, vector_col)
    return apply(blocks, fit(blocks, components, seed))
