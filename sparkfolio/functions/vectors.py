"""Vector functions: native expressions, and for scans a matrix product over Arrow batches, which needs no boxing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    """The vector over its Euclidean length; a zero vector as it is."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either has no length; the longer vector is cut to the shorter, but for its length."""
    size = F.least(F.size(a), F.size(b))
    dot = _sum(F.zip_with(F.slice(as_double(a), F.lit(1), size), F.slice(as_double(b), F.lit(1), size), lambda x, y: x * y))
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot / length)


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def score_percent(distance: Column) -> Column:
    """Distance 0.7 and less is 100, 1 and more is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(1.0) - distance) / 0.3 * 100))


def distance_of_rank(rank: Column) -> Column:
    """A lexical rank on the scale of distances."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - rank * 2)


def _over_batches(score, size: int) -> Column:
    """An Arrow function of vectors of one length; null for null vectors and those of another length."""

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(v), size), False))
        out = np.zeros(len(v))
        if fits.any():
            out[fits] = score(np.asarray(v.filter(pa.array(fits)).flatten(), np.float64).reshape(-1, size))
        return pa.array(out, mask=~fits)

    return run


def l2_distances(v: Column, query) -> Column:
    """Distance of each vector to one query; null for a vector of another length."""
    q = np.array(query, np.float64)
    return _over_batches(lambda x: np.sqrt(((x - q) ** 2).sum(axis=1)), len(q))(v)


def cosine_similarities(v: Column, query) -> Column:
    q = np.array(query, np.float64)

    def score(x: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
        return np.where(length == 0, 0.0, x @ q / np.where(length == 0, 1, length))

    return _over_batches(score, len(q))(v)
