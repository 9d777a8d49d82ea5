import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import index, search, vector_codes


def plain(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("d", [1, 5, 16])
def test_codes_give_the_exact_neighbours(spark, d, monkeypatch):
    monkeypatch.setattr(vector_codes, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(d)
    x = rng.standard_normal((600, d)).astype(np.float32)
    x[100:160] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0] * (d + 1)), (1002, [None] * d)], "id long, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:10])] + [(50, (x[0] * 3).tolist()), (60, None), (61, [0.0] * (d + 2))], "query_id long, embedding array<float>")
    books = vector_codes.Codebooks.fit(rows, cells=5, sample=200)
    codes = books.codes(rows).cache()
    assert codes.count() == 600  # every vector is coded, however few were fitted on
    got = plain(vector_codes.nearest_by_codes(books, codes, rows.where("id < 1000"), queries, 4))
    assert got == plain(search.knn_join(rows.where("id < 1000"), queries.where("query_id < 60"), 4)) and len(got) == 44
    few = rows.where("id < 3")
    assert len(plain(vector_codes.nearest_by_codes(books, books.codes(few), few, queries, 4))) == 33
    assert vector_codes.nearest_by_codes(books, codes, rows, queries.limit(0), 4).count() == 0


def test_few_vectors_are_measured(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    books = vector_codes.Codebooks.fit(rows)
    found = vector_codes.nearest_by_codes(books, books.codes(rows).cache(), rows, queries, 5)
    measured = len(plain(found))
    asked = np.array([r["embedding"] for r in queries.orderBy("query_id").collect()], float)
    x = np.array([r["embedding"] for r in rows.orderBy("id").collect()], float)
    cell, code, error = books.encode(x)
    batch = pa.record_batch({"cell": pa.array(cell, pa.int32()), "code": pa.array([c.tobytes() for c in code], pa.binary()), "error": pa.array(error, pa.float32())})
    lower, upper = np.full((len(asked), len(x)), np.inf), np.full((len(asked), len(x)), np.inf)
    for q, at, low, high in books.bounds(batch, asked):
        lower[q, at], upper[q, at] = low, high
    exact = np.sqrt(((x[None] - asked[:, None]) ** 2).sum(axis=2))
    assert (lower <= exact).all() and (exact <= upper).all()
    reach = np.sort(upper, axis=1)[:, 4:5]
    assert (lower <= reach).mean() < 0.2 and measured == 5 * len(asked)


def test_cells_go_on_until_exact(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    cells = index.Cells.fit(rows, 16)
    assert plain(index.near_join(cells.assign(rows), cells, queries, 6, probe=1, exact=True)) == plain(search.knn_join(rows, queries, 6))


def test_cells_form_no_pairs_of_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(index, "QUERY_BLOCK", 3)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    cells = index.Cells.fit(rows, 16)
    found = index.near_join(cells.assign(rows), cells, queries, 6, probe=2, exact=True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert plain(found) == plain(search.knn_join(rows, queries, 6))
