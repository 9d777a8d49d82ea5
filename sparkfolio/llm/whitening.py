"""Whitening of embeddings by one-sided Jacobi SVD over blockwise TSQR.

Each distinct vector counts once. Tasks reduce blocks of centred rows to triangular factors, groups of factors to one factor
each, until one is left. Plane rotations make its columns orthogonal: their lengths are the singular values, to high relative accuracy since no product of
the rows with themselves is ever formed, and the rotations together are the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, small_batches

#: An entry c counts as floor(SCALE * c) + SHIFT. SHIFT only moves the mean, so the work is done without it.
SCALE, SHIFT = 64, 1000000
COMPONENTS = 16
#: Factors that are stacked at a time, and rows of a block.
FAN_IN, BLOCK = 16, 4096
#: Entries beyond this count as this, so that they are whole numbers in a double.
MOST = 2**53
#: Components whose deviation is under this share of the largest one's have none, by double precision.
LEAST_DEVIATION = 1e-10
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def whole_numbers(vectors: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * c) of the vectors that have ``dimensions`` finite entries, and which of the rows these are."""
    fits = pc.equal(pc.list_value_length(vectors), dimensions).fill_null(False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(vectors.filter(fits)).cast(pa.float64())
    flat = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    finite = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * flat[finite]), -MOST, MOST).astype(np.int64), at[finite]


def pack(rows: np.ndarray) -> list[bytes]:
    """Rows as bytes, in the fewest bytes an entry that hold the row; equal rows, equal bytes."""
    out: list[bytes] = [b""] * len(rows)
    low, high = rows.min(axis=1, initial=0), rows.max(axis=1, initial=0)
    left = np.arange(len(rows))
    for width in WIDTHS:
        fits = (low[left] >= np.iinfo(width).min) & (high[left] <= np.iinfo(width).max)
        now, left = left[fits], left[~fits]
        whole = rows[now].astype(width).tobytes()
        size = rows.shape[1] * width().itemsize
        for k, i in enumerate(now.tolist()):
            out[i] = whole[k * size : (k + 1) * size]
    return out


def unpack(packed: pa.Array, dimensions: int) -> np.ndarray:
    size = pc.binary_length(packed).to_numpy(zero_copy_only=False) // dimensions
    out = np.empty((len(packed), dimensions), np.int64)
    for width in WIDTHS:
        of = size == width().itemsize
        if of.any():
            out[of] = np.frombuffer(b"".join(packed.filter(pa.array(of)).to_pylist()), width).reshape(-1, dimensions)
    return out


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * row - sums, exact: as int64 if it fits, else as Python's numbers."""
    most = int(np.abs(rows).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most < 2**63:
        return rows * np.int64(n) - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def square_sums(moved: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row; None where one doesn't fit in 64 bits."""
    most = max(abs(int(moved.max(initial=0))), abs(int(moved.min(initial=0))))
    if most * most * moved.shape[1] < 2**63:
        moved = moved.astype(np.int64)
        return (moved * moved).sum(axis=1).tolist()
    return [None if s >= 2**63 else s for s in (sum(x * x for x in map(int, row)) for row in moved)]


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Disjoint pairs of columns, so that each pair comes up once in d - 1 rounds (d is even)."""
    ring = np.arange(d)
    for _ in range(d - 1):
        yield ring[: d // 2], ring[::-1][: d // 2]
        ring[1:] = np.roll(ring[1:], 1)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and the right singular vectors as columns, by plane rotations from the right until all columns are orthogonal."""
    d = r.shape[1]
    even = d + d % 2
    a = np.zeros((r.shape[0], even))
    a[:, :d] = r
    v = np.eye(even)
    for _ in range(60):
        turned = False
        for p, q in _rounds(even):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > d * 2.0**-53 * np.sqrt(xx) * np.sqrt(yy)
            if not turn.any():
                continue
            turned = True
            p, q, xx, yy, xy = p[turn], q[turn], xx[turn], yy[turn], xy[turn]
            with np.errstate(over="ignore"):
                z = (yy - xx) / (2 * xy)
                t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    size = np.sqrt((a[:, :d] * a[:, :d]).sum(axis=0)) if d == even else np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-size, kind="stable")[:d]
    return size[order], v[:d, order]


@dataclass
class Whitening:
    n: int
    #: sums of each dimension, without SHIFT
    sums: list[int]
    #: columns, falling deviation
    components: np.ndarray
    deviation: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, moved: np.ndarray) -> np.ndarray:
        return (moved.astype(np.float64) / self.n) @ self.components / self.deviation


def _packed(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = whole_numbers(batch.column("vector"), dimensions)
            yield pa.record_batch({"x": pa.array(pack(rows), pa.binary())})

    return run


def _sums(dimensions: int):
    """The number of rows as dimension -1, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dimensions + 1)
        for batch in batches:
            rows = unpack(batch.column("x"), dimensions)
            kind = rows if int(np.abs(rows).max(initial=0)) * len(rows) < 2**63 else rows.astype(object)
            total = [a + int(b) for a, b in zip(total, [len(rows), *kind.sum(axis=0)])]
        yield pa.record_batch({"dimension": pa.array(range(-1, dimensions), pa.int32()), "total": pa.array(total, pa.decimal128(38, 0))})

    return run


def _factor(rows: np.ndarray) -> np.ndarray:
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _factors(n: int, sums: list[int]):
    """One triangular factor of a task's centred rows, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sums)
        r, some = np.zeros((d, d)), False
        for batch in batches:
            centred = deviations(unpack(batch.column("x"), d), n, sums).astype(np.float64) / n
            for i in range(0, len(centred), BLOCK):
                r, some = _factor(np.vstack([r, centred[i : i + BLOCK]])), True
        if some:
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def _stacked(width: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("part")  # so that reruns agree
        rows = [np.frombuffer(b, np.float64) for b in group["r"].to_pylist()]
        d = int(len(rows[0]) ** 0.5)
        r = _factor(np.vstack([x.reshape(d, d) for x in rows]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def _factor_of(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows: groups of ``FAN_IN`` factors are stacked until one is left."""
    factors = materialise(fit.mapInArrow(_factors(n, sums), "part long, r binary"))
    left = factors.agg(F.max("part") + 1).first()[0]
    while left > 1:
        left = -(-left // FAN_IN)
        fewer = materialise(factors.groupBy((F.col("part") % left).alias("g")).applyInArrow(_stacked(left), "part long, r binary"))
        release(factors)
        factors = fewer
    r = np.frombuffer(factors.first()["r"], np.float64).reshape(len(sums), len(sums))
    release(factors)
    return r


def _scatter(model: Whitening):
    """Sums of whitened entries (second is -1) and of their products over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.deviation)
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(deviations(unpack(batch.column("x"), len(model.sums)), model.n, model.sums))
            total += w.sum(axis=0)
            product += w.T @ w
        i, j = np.divmod(np.arange(k * k), max(k, 1))
        yield pa.record_batch({"i": pa.array([*range(k), *i], pa.int32()), "j": pa.array([-1] * k + j.tolist(), pa.int32()), "total": pa.array([*total, *product.ravel()], pa.float64())})

    return run


def fit_whitening(embeddings: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Learns from each distinct vector once. None without a vector; no components where all vectors are equal.

    Vectors of another length than the most frequent one (of equally frequent ones the longest), and those that hold null or non-finite entries, count for nothing.
    The driver gets sums by dimension and triangles of dimensions x dimensions, whatever the number of rows.
    """
    small_batches(embeddings.sparkSession)
    vectors = embeddings.select(F.col(vector_col).alias("vector"))
    size = vectors.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return None
    d = size["size"]
    fit = materialise(vectors.mapInArrow(_packed(d), "x binary").distinct())
    totals = {r["dimension"]: int(r["total"]) for r in fit.mapInArrow(_sums(d), "dimension int, total decimal(38,0)").groupBy("dimension").agg(F.sum("total").alias("total")).collect()}
    n, sums = totals.get(-1, 0), [totals.get(i, 0) for i in range(d)]
    if not n:
        release(fit)
        return None
    size, turns = jacobi(_factor_of(fit, n, sums))
    k = min(components, int((size > LEAST_DEVIATION * size[0]).sum()))
    model = Whitening(n, sums, turns[:, :k], size[:k] / np.sqrt(n), size[:k] ** 2 / max((size**2).sum(), np.finfo(float).tiny))
    if k:
        cov, mean = -np.eye(k), np.zeros(k)
        for r in fit.mapInArrow(_scatter(model), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # k * k + k rows
            if r["j"] < 0:
                mean[r["i"]] = r["total"] / n
            else:
                cov[r["i"], r["j"]] += r["total"] / n
        model.identity_error = float(np.abs(cov - np.outer(mean, mean)).max())
    release(fit)
    return model


def _whitened(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.deviation)
        for batch in batches:
            rows, at = whole_numbers(batch.column("vector"), len(model.sums))
            moved = deviations(rows, model.n, model.sums)
            out = len(at) * k
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    "n": pa.array(np.full(out, model.n, np.int64)),
                    "deviation": pa.array(square_sums(moved), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    "whitened": pa.array(model.whitened(moved).ravel()),
                    "explained": pa.array(np.tile(model.explained, len(at))),
                    "identity_error": pa.array(np.full(out, model.identity_error)),
                }
            )

    return run


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, model: Whitening | None = None) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (1 on, by falling variance), n, deviation, whitened, explained, identity_error.

    Null vectors, vectors with null or non-finite entries and those of another length than the most frequent one give no rows; rows that repeat a vector or an id give rows each, but
    count once in what is learned. A component that no vector deviates along (under 1e-10 of the largest deviation) has no rows, so there are none for equal
    vectors or an empty table. ``deviation`` is null where it doesn't fit in 64 bits; entries count as 2**53 / 64 at most.
    """
    model = model or fit_whitening(embeddings, vector_col, components)
    mine = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    schema = f"vec_id {mine.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    return mine.mapInArrow(_whitened(model), schema)
