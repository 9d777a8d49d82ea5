import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import queries, whitening


def slow(vectors):
    """Distinct whole vectors, covariance by exact centring, eigenvectors by LAPACK."""
    x = np.unique(np.floor(64 * np.array(vectors, float)).astype(np.int64), axis=0)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, e[::-1], v[:, ::-1]


def check(df, vectors, ids, k=16):
    n, sums, e, v = slow(vectors)
    k = min(k, int((e > 1e-18 * e[0]).sum()))
    rows = sorted(df.collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert len(rows) == k * len(ids) and {r["n"] for r in rows} == {n}
    got = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    x = np.floor(64 * np.array([vectors[i] for i in np.argsort(ids, kind="stable")], float)).astype(np.int64)
    want = ((n * x - sums) / n) @ v[:, :k] / np.sqrt(e[:k])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-6
    assert np.allclose([r["explained"] for r in rows[:k]], e[:k] / e.sum(), rtol=1e-9)
    assert [r["deviation"] for r in rows[::k]] == [int(sum(int(a) ** 2 for a in n * y - sums)) for y in x]
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_query_by_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    check(queries.QUERIES["op13_embedding_whitening"](spark, sf), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


@pytest.mark.parametrize("d", [1, 2, 5, 20])
def test_dimensions_repeats_and_parts(spark, d, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((300, d)) * 10.0 ** -np.linspace(0, 1.5, d) * 3).astype(np.float32)
    vectors[100:200] = vectors[3]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, part string").repartition(5)
    check(whitening.whiten(df), vectors, np.arange(300))


def test_rows_that_are_dropped_and_huge_entries(spark):
    good = [[0.1, 1.0], [0.5, -2.0], [0.9, 0.25], [1e3, -1e3]]
    rows = [(i, v) for i, v in enumerate(good)] + [(10, None), (11, [None, 1.0]), (12, [float("nan"), 1.0]), (13, [1.0, float("-inf")]), (14, [1.0]), (15, []), (16, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(whitening.whiten(df), good, np.arange(4))
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "vec_id int, embedding array<double>")).collect()
    assert far and all(r["deviation"] is None or r["deviation"] >= 0 for r in far)


def test_no_components(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], schema)
    assert whitening.whiten(line).agg(F.max("component")).first()[0] == 1


def test_jacobi_is_accurate_for_small_singular_values():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    sizes = 10.0 ** -np.arange(9)
    # Columns of very different scale: products of the matrix with itself would lose the small values.
    found, turns = whitening.jacobi(q * sizes)
    assert np.allclose(found, sizes, rtol=1e-13) and np.allclose(turns.T @ turns, np.eye(9), atol=1e-14)
    r = rng.standard_normal((9, 9))
    assert np.allclose(whitening.jacobi(r)[0], np.linalg.svd(r)[1], rtol=1e-12)


def test_packed_rows_come_back():
    rows = np.array([[0, 1], [-128, 127], [128, 0], [-40000, 7], [2**40, -(2**53)]])
    import pyarrow as pa

    assert (whitening.unpack(pa.array(whitening.pack(rows), pa.binary()), 2) == rows).all()
    assert [len(b) for b in whitening.pack(rows)] == [2, 2, 4, 8, 16]
