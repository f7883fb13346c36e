"""Whitening of embeddings: streaming covariance by partitions, merged, and a symmetric QR eigen-solve.

Each partition's iterator holds a mean and a matrix of centred products and takes one
vector after the other as a rank-one update (Welford); partitions' states are merged by
the parallel update formula (Chan, Golub, LeVeque), ``FAN`` at a time on executors, so the
driver receives ``FAN`` states at most.  The covariance is made tridiagonal by reflections
and diagonal by implicitly shifted QR steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import bounded_batches, cut, forget, lean, send

SCALE = 256
COMPONENTS = 4
#: States that a task merges.
FAN = 16
#: Eigenvalues below this share of the trace, by dimension, are rounding.
EPS = 1e-13
STATE = "part long, n long, dim int, total array<long>, mean array<double>, products array<double>"
_NAMES = ["part", "n", "dim", "total", "mean", "products"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
LONG = 1 << 63


class Moments:
    """Count, mean, and sums of centred products of vectors."""

    def __init__(self, dim: int):
        self.n, self.mean, self.products = 0, np.zeros(dim), np.zeros((dim, dim))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update of the products."""
        self.n += 1
        off = x - self.mean
        self.mean += off / self.n
        self.products += np.outer(off, x - self.mean)

    def merge(self, other: Moments) -> None:
        n, off = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.outer(off, off) * (self.n * other.n / n)
        self.mean += off * (other.n / n)
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)


def _rotation(a: float, b: float) -> tuple[float, float]:
    """Cosine and sine that turn (a, b) into (r, 0)."""
    if b == 0:
        return 1.0, 0.0
    r = np.hypot(a, b)
    return a / r, b / r


def symmetric_qr(matrix: np.ndarray, tolerance: float = np.finfo(float).eps) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    Householder reflections to tridiagonal form, then QR steps with Wilkinson's shift
    on the part that has not settled.  A vector's largest entry is positive.
    """
    a = np.array(matrix, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        p = 2 * (a[k + 1 :, k + 1 :] @ x)
        w = p - (x @ p) * x
        a[k + 1 :, k + 1 :] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ x, 2 * x)
    d, e = a.diagonal().copy(), a.diagonal(-1).copy()
    rows = q.T.copy()  # a rotation turns two of these rows
    last = n - 1
    steps = 0
    while last > 0:
        small = tolerance * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[np.abs(e) <= small] = 0.0
        while last > 0 and e[last - 1] == 0:
            last -= 1
        if last == 0:
            break
        first = last - 1
        while first > 0 and e[first - 1] != 0:
            first -= 1
        if (steps := steps + 1) > 60 * n:
            raise RuntimeError("eigenvalues did not settle")
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + np.copysign(np.hypot(half, e[last - 1]), half if half else 1.0))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            c, s = _rotation(x, z)
            if k > first:
                e[k - 1] = c * x + s * z
            top, low, side = d[k], d[k + 1], e[k]
            d[k] = c * c * top + 2 * c * s * side + s * s * low
            d[k + 1] = s * s * top - 2 * c * s * side + c * c * low
            e[k] = c * s * (low - top) + (c * c - s * s) * side
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
            if k < last - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
    order = np.argsort(-d, kind="stable")
    vectors = rows[order].T
    if n:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(n)] < 0, -1.0, 1.0)
    return d[order], vectors


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _state(part: int, m: Moments, total: np.ndarray) -> pa.RecordBatch:
    row = [[part], [m.n], [len(m.mean)], [total], [m.mean], [m.products.ravel()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _TYPES, strict=True)], _NAMES)


def moments(vectors: DataFrame, column: str = "x") -> tuple[Moments, np.ndarray] | None:
    """Of vectors of one dimension, without nulls: their moments, and their exact sums if they are whole numbers.

    None for an empty table.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, total = None, None
        for b in batches:
            x = _matrix(b.column(0), float)
            if not len(x):
                continue
            if m is None:
                m, total = Moments(x.shape[1]), np.zeros(x.shape[1], np.int64)
            for row in x:
                m.add(row)
            within(m)
            if pa.types.is_integer(b.schema.field(0).type.value_type):
                total += _matrix(b.column(0), np.int64).sum(0)
        if m is not None:
            yield _state(TaskContext.get().partitionId(), m, total)

    def within(m: Moments) -> None:
        if m.n and np.abs(m.mean).max() * m.n >= LONG / 2:
            raise OverflowError("the sums of a dimension exceed a long")

    def merged(rows: list[dict]) -> tuple[Moments, np.ndarray]:
        m, total = Moments(rows[0]["dim"]), np.zeros(rows[0]["dim"], np.int64)
        for r in sorted(rows, key=lambda r: r["part"]):
            other = Moments(r["dim"])
            other.n, other.mean, other.products = r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(r["dim"], r["dim"])
            m.merge(other)
            within(m)
            total += np.array(r["total"], np.int64)
        return m, total

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        for part in sorted({r["part"] // FAN for r in rows}):
            yield _state(part, *merged([r for r in rows if r["part"] // FAN == part]))

    states = cut(bounded_batches(vectors).select(column).mapInArrow(lean(stream), STATE))
    while (n := states.count()) > FAN:
        parts = max(1, -(-n // FAN))
        smaller = cut(states.repartition(parts, F.floor(F.col("part") / FAN)).mapInArrow(lean(merge), STATE))
        forget(states)
        states = smaller
    rows = [r.asDict() for r in states.collect()]
    forget(states)
    return merged(rows) if rows else None


def prepared(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: usable vectors, their entries times ``scale`` rounded down to longs.

    A vector that is null, empty or holds null, NaN or infinite entries is left out, and
    so is one with a scaled entry that no long holds (2^62 and beyond).
    """
    c = F.transform(F.col(vec_col), lambda v: v.cast("double") * scale)
    fits = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**62))
    x = vectors.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.coalesce(fits, F.lit(False)))
    return x.select(F.col(id_col).alias("vec_id"), F.transform(c, lambda v: F.floor(v)).alias("x"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` by usable vector and leading component.

    Moments are those of the distinct vectors.  Components without variance, as of a
    single vector or of fewer vectors than components, are left out; so are unusable
    vectors (``prepared``); repeated rows stay repeated; a null id stays null; an empty
    table gives no rows; vectors of several dimensions and sums beyond a long are errors;
    other columns are not read.  ``deviation`` is null where no long holds it.
    """
    spark = vectors.sparkSession
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = prepared(vectors, vec_col, id_col, scale)
    kind = x.schema["vec_id"].dataType.simpleString()
    distinct = cut(x.select("x").distinct())
    low, high = distinct.select(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low is None:
        return spark.createDataFrame([], f"vec_id {kind}, {out}")
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} dimensions")
    found = moments(distinct)
    assert found is not None
    m, total = found
    values, basis = symmetric_qr(m.covariance())
    trace = values.sum()
    held = int((values[:components] > EPS * len(values) * max(trace, 0.0)).sum())
    turn = basis[:, :held] / np.sqrt(values[:held])
    n, names = m.n, [f.split()[0] for f in ("vec_id " + kind + ", " + out).split(", ")]
    sent = send(spark, (n, total, turn, values[:held] / trace if trace > 0 else values[:held]))  # a few numbers a dimension

    def project(x: np.ndarray) -> np.ndarray:
        n, total, turn, _ = sent.value
        return (x - total / n) @ turn

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(project(_matrix(b.column(0), np.int64))), pa.list_(pa.float64()))], ["w"])

    if not held:
        return spark.createDataFrame([], f"vec_id {kind}, {out}")
    checked = moments(distinct.mapInArrow(lean(spread), "w array<double>"), "w")
    forget(distinct)
    error = float(np.abs(checked[0].covariance() - np.eye(held)).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        n, total, *_ = sent.value
        if np.abs(x.astype(float) * n - total).max(initial=0.0) ** 2 * x.shape[1] < LONG / 4 and np.abs(x).max(initial=0) * float(n) < LONG / 4:
            return ((x * n - total) ** 2).sum(1).tolist()
        exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
        return [v if v < LONG else None for v in exact]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = sent.value[3]
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), np.int64)
            k, each = len(share), np.repeat(np.arange(b.num_rows), len(share))
            size = len(each)
            cols = [
                b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(size, n)),
                pa.array(deviations(x), pa.int64()).take(pa.array(each)), pa.array(project(x).ravel()), pa.array(np.tile(share, b.num_rows)), pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    return bounded_batches(x).mapInArrow(lean(rows), f"vec_id {kind}, {out}")
