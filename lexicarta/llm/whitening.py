"""Whitening of embeddings by the leading eigenvectors of their covariance.

Entries become integers, ``x = floor(64 c) + 1000000``; every distinct vector is fitted once.

* One pass over the distinct vectors sums them, exactly and by dimension. A second one
  centres them and adds up the products of the upper triangle. Each task sends one row
  per entry of the triangle, whatever the number of its vectors, and Spark adds them.
* The driver holds the covariance, dimension by dimension. Householder reflections make it
  tridiagonal; counts of Sturm's sequence, bisected for all wanted eigenvalues at once,
  give the leading ones; inverse iteration gives their vectors, which are made orthogonal
  again inside clusters of close eigenvalues, and reflected back.
* The projection, dimensions by components, goes to every task with the function that
  uses it. A last pass over the distinct vectors measures the covariance of what it gives.

Defined results: rows whose vector is null, or holds a null or an entry that is not finite,
are left out. A vector without entries has no components, so no rows. Vectors of several
lengths are an error, since they have no covariance. Every remaining row gives its own
rows, also where ids repeat or are null. There are as many components as dimensions, 16 at
most; one without variance has a null ``whitened``, and so has every one if all vectors
are equal, where ``explained`` is null too. Extra columns are ignored. An empty table gives an
empty result. ``deviation`` is exact as ``decimal(38, 0)``.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.session import materialize

# Fixed values of the integer form.
SCALE = 64
SHIFT = 1_000_000

COMPONENTS = 16
#: Entries of vectors that a task works on at once.
SLICE_ENTRIES = 1 << 19
#: Rounds of inverse iteration for a vector.
ROUNDS = 4
#: Eigenvalues closer than this share of the largest are one cluster.
CLUSTER = 1e-3

SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, "
    "explained double, identity_error double"
)


# --- eigenvectors of a symmetric matrix ---------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflection vectors of Householder's reduction."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = math.sqrt(float(v @ v))
        v[0] += math.copysign(length, v[0])
        norm = math.sqrt(float(v @ v))
        if not norm:
            reflections.append(np.zeros(d - k - 1))
            continue
        v /= norm
        reflections.append(v)
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = 2 * (p - (v @ p) * v)
        below -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value of ``at`` the number of eigenvalues below it."""
    tiny = np.finfo(np.float64).tiny
    squares = np.concatenate([[0.0], off * off])
    q = np.ones(len(at))
    counts = np.zeros(len(at), dtype=np.int64)
    for i in range(len(diagonal)):
        q = diagonal[i] - at - squares[i] / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        counts += q < 0
    return counts


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest, falling, by bisection until no double lies between the bounds."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    pad = 1e-12 * max(1.0, float(np.max(np.abs(diagonal) + reach)))
    low = np.full(k, float(np.min(diagonal - reach)) - pad)
    high = np.full(k, float(np.max(diagonal + reach)) + pad)
    rank = d - 1 - np.arange(k)  # the number of eigenvalues below the wanted one
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        above = sturm_counts(diagonal, off, middle) > rank
        high = np.where(above, middle, high)
        low = np.where(above, low, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) y = right`` by elimination with row exchanges; tiny pivots are ``least``."""
    d = len(diagonal)
    main = (diagonal - shift).tolist()
    up = off.tolist() + [0.0]
    up2 = [0.0] * d
    y = right.tolist()
    for i in range(d - 1):
        below, nxt, far = float(off[i]), main[i + 1], up[i + 1]
        if abs(below) > abs(main[i]):
            factor = main[i] / below
            main[i], up[i], up2[i], main[i + 1], up[i + 1] = below, nxt, far, up[i] - factor * nxt, -factor * far
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            if abs(main[i]) < least:
                main[i] = least
            factor = below / main[i]
            main[i + 1] = nxt - factor * up[i]
            y[i + 1] -= factor * y[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(d - 1, -1, -1):
        rest = y[i]
        if i + 1 < d:
            rest -= up[i] * y[i + 1]
        if i + 2 < d:
            rest -= up2[i] * y[i + 2]
        y[i] = rest / main[i]
        if abs(y[i]) > 1e150:  # only the direction counts
            y = [v * 1e-150 for v in y]
    return np.array(y)


def leading_eigenvectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit vectors as columns."""
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, k)
    d = len(diagonal)
    size = float(np.max(np.abs(diagonal)) + (np.max(np.abs(off)) if len(off) else 0.0))
    if not size:
        return np.zeros(k), np.eye(d)[:, :k]
    least = np.finfo(np.float64).eps * size
    rng = np.random.default_rng(1)
    vectors = np.zeros((d, k))
    first = 0
    shift = math.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * size:
            first = j
        shift = min(float(values[j]), shift - 2 * least)  # equal values are told apart
        y = rng.standard_normal(d)
        for _ in range(ROUNDS):
            y = _solved(diagonal, off, shift, y / np.max(np.abs(y)), least)
            y /= math.sqrt(float((y / np.max(np.abs(y))) @ (y / np.max(np.abs(y))))) * np.max(np.abs(y))
            for _ in range(2):  # once more against what rounding leaves
                y -= vectors[:, first:j] @ (vectors[:, first:j].T @ y)
            y /= math.sqrt(float(y @ y))
        vectors[:, j] = y
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    for j in range(k):  # of vectors far apart only rounding is left
        for _ in range(2):
            vectors[:, j] -= vectors[:, :j] @ (vectors[:, :j].T @ vectors[:, j])
        vectors[:, j] /= math.sqrt(float(vectors[:, j] @ vectors[:, j]))
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- the fit ------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """Of ``n`` vectors: sums less the shift, and the projection; all small next to the vectors."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def has_variance(self) -> np.ndarray:
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(np.float64).eps

    @property
    def projection(self) -> np.ndarray:
        """Centred vectors times this are whitened; NaN where a component has no variance."""
        scale = np.where(self.has_variance, np.sqrt(np.where(self.has_variance, self.values, 1.0)), np.nan)
        return self.vectors / scale


def integers(vector: Column) -> Column:
    """The integer form of a vector; null where the vector is not to be used."""
    usable = vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    return F.when(
        usable, F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("bigint"))
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors ``x``, less the shift, as rows."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            wide = len(batch.column("x")[start])
            part = batch.slice(start, max(1, SLICE_ENTRIES // max(1, wide)))
            flat = pc.list_flatten(part.column("x")).to_numpy(zero_copy_only=False)
            if len(flat) != wide * part.num_rows or pc.any(pc.not_equal(pc.list_value_length(part.column("x")), wide)).as_py():
                raise ValueError("the vectors have several lengths")
            yield part, flat.reshape(part.num_rows, wide) - SHIFT
            start += part.num_rows


def _summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> list[tuple]:
    """Sums over all vectors of a matrix that ``of`` makes of a slice: ``(i, j, value)``, null j counts rows.

    A task adds its slices up and sends the entries of the matrix only.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for _, x in _slices(batches):
            rows += len(x)
            if total is not None and total.shape != of(x[:0]).shape:
                raise ValueError("the vectors have several lengths")
            total = of(x) if total is None else total + of(x)
        if total is None:
            return
        i, j = np.nonzero(np.triu(np.ones(total.shape, bool)) if total.shape[0] > 1 else np.ones(total.shape, bool))
        kinds = (pa.int32(), pa.int32(), pa.float64() if kind == "double" else pa.int64())
        values = np.append(total[i, j], total.dtype.type(0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(i, total.shape[1]), kinds[0]),
                pa.array(np.append(j, -1), kinds[1]),
                pa.array(values, kinds[2]),
                pa.array(np.append(np.zeros(len(i), np.int64), rows)),
            ],
            names=["i", "j", "value", "rows"],
        )

    sums = fit.mapInArrow(added, f"i int, j int, value {kind}, rows bigint").groupBy("i", "j")
    exact = F.sum(F.col("value").cast("decimal(38,0)")) if kind == "bigint" else F.sum("value")
    return [tuple(r) for r in sums.agg(exact, F.sum("rows")).collect()]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``(x)``, every vector once; None without vectors."""
    found = _summed(distinct, lambda x: x.sum(axis=0, keepdims=True), "bigint")
    sizes = {i: rows for i, j, _, rows in found if j == -1}
    if len(sizes) > 1:
        raise ValueError("the vectors have several lengths")
    if not sizes:
        return None
    (d, n), = sizes.items()
    sums = dict((j, int(value)) for _, j, value, _ in found if j != -1)
    sums = tuple(sums[j] for j in range(d))
    centre = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - centre
        return centred.T @ centred

    covariance = np.zeros((d, d))
    for i, j, value, _ in _summed(distinct, products, "double"):
        if j != -1:
            covariance[i, j] = covariance[j, i] = value / n
    values, vectors = leading_eigenvectors(covariance, min(components, d))
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest entry by which the covariance of the whitened vectors departs from the identity."""
    projection, centre = model.projection[:, model.has_variance], model.centre
    k = projection.shape[1]
    if not k:
        return None

    def moments(x: np.ndarray) -> np.ndarray:
        """Products of the whitened vectors, with their sums as a further column and row."""
        white = np.column_stack([(x - centre) @ projection, np.ones(len(x))])
        return white.T @ white

    found = np.zeros((k + 1, k + 1))
    for i, j, value, _ in _summed(distinct, moments, "double"):
        if j != -1:
            found[i, j] = found[j, i] = value / model.n
    mean = found[k, :k]  # of centred vectors: what rounding leaves
    return float(np.max(np.abs(found[:k, :k] - np.outer(mean, mean) - np.eye(k))))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Exact sums over the dimensions of ``(n x - S)^2``; the shift cancels."""
    reach = n * int(np.max(np.abs(x), initial=0)) + max((abs(s) for s in sums), default=0)
    if reach * reach * max(1, len(sums)) < 1 << 62:
        apart = n * x - np.array(sums, dtype=np.int64)
        return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
    apart = n * x.astype(object) - np.array(sums, dtype=object)
    with decimal.localcontext(decimal.Context(prec=60)):
        return pa.array([decimal.Decimal(int(v)) for v in (apart * apart).sum(axis=1)], pa.decimal128(38, 0))


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row of ``table`` with a usable vector, and component.

    ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.
    """
    spark = table.sparkSession
    rows = table.select(
        F.col(f"`{key}`").cast("bigint").alias("vec_id"), integers(F.col(f"`{vector}`")).alias("x")
    ).where("size(x) > 0")
    # Spark drops repeats in every task before the shuffle, so a vector that a third of the rows share costs little.
    distinct = materialize(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, components)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(distinct, model)
    projection, centre, k = model.projection, model.centre, len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
    n, sums = model.n, model.sums

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches):
            m = part.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            white = ((x - centre) @ projection).reshape(-1)
            shares = np.tile(explained, m)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)),
                    deviations(x, n, sums).take(each),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(shares, mask=np.isnan(shares)),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(projected, SCHEMA)
