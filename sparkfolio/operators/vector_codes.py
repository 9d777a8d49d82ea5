"""Product-quantised vectors that give the exact nearest neighbours.

A vector is written as its cell, one byte for each of its pieces (the nearest entry of the piece's codebook, for the rest that the cell's centre leaves) and how far all that is from
the vector itself. From the bytes a query's distance is known up to that error, in both directions. So the k-th smallest upper bound is found from the codes alone, and only rows whose lower bound
reaches it are read and measured. The codebooks are fitted on a bounded sample; every vector is coded, and no row is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from .index import Cells

#: Vectors that codebooks are fitted on, chosen by hash; dimensions of a piece; entries of a codebook; rounds of fitting; cells.
SAMPLE, PIECE, ENTRIES, ROUNDS, CELLS = 8192, 2, 256, 10, 16
#: Queries that go to all executors at a time.
QUERY_BLOCK = 500
#: Added to errors for what 32-bit floats round away.
SLACK = 1e-5
CODES = "id long, code binary, error float, cell int"


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``size`` finite entries, and which rows they are."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    flat = pc.fill_null(column.take(pa.array(rows)).flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
    fine = np.isfinite(flat).all(axis=1)
    return flat[fine], rows[fine]


@dataclass
class Codebooks:
    cells: Cells
    #: pieces x entries x dimensions of a piece
    entries: np.ndarray

    @property
    def size(self) -> int:
        return self.cells.centres.shape[1]

    def pieces(self, x: np.ndarray) -> np.ndarray:
        """pieces x rows x dimensions; a last piece is filled up with zeros."""
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % PIECE)))
        return x.reshape(len(x), -1, PIECE).transpose(1, 0, 2)

    @classmethod
    def fit(cls, rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE, id_col: str = "id") -> Codebooks:
        """From ``sample`` vectors; of vectors of several lengths those of the first one's."""
        picked = rows.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select("embedding").collect()
        size = len(picked[0]["embedding"]) if picked else 1
        x = np.array([r["embedding"] for r in picked if len(r["embedding"]) == size and None not in r["embedding"]], np.float64).reshape(-1, size)
        x = x[np.isfinite(x).all(axis=1)]
        rng = np.random.default_rng(0)
        book = cls(Cells(x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((1, size))), np.zeros((0, 1, PIECE)))
        for _ in range(ROUNDS if len(x) else 0):
            near = book.cells.nearest(x, 1)[:, 0]
            book.cells = Cells(np.array([x[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(book.cells.centres)]))
        rest = book.pieces(x - book.cells.centres[book.cells.nearest(x, 1)[:, 0]]) if len(x) else np.zeros((-(-size // PIECE), 1, PIECE))
        entries = []
        for part in rest:  # one codebook for each piece
            of = part[rng.choice(len(part), min(ENTRIES, len(part)), replace=False)]
            for _ in range(ROUNDS):
                near = ((of**2).sum(axis=1) - 2 * part @ of.T).argmin(axis=1)
                count = np.bincount(near, minlength=len(of))
                sums = np.stack([np.bincount(near, part[:, j], len(of)) for j in range(PIECE)], axis=1)
                of = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], of)
            entries.append(of)
        return cls(book.cells, np.array(entries))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, bytes and error of each vector."""
        cell = self.cells.nearest(x, 1)[:, 0]
        pieces = self.pieces(x - self.cells.centres[cell])
        code = np.stack([((e**2).sum(axis=1) - 2 * p @ e.T).argmin(axis=1) for p, e in zip(pieces, self.entries)], axis=1).astype(np.uint8)
        gone = pieces - self.entries[np.arange(len(self.entries))[:, None], code.T]
        return cell, code, np.sqrt((gone**2).sum(axis=(0, 2))) * (1 + SLACK) + SLACK

    def codes(self, rows: DataFrame, id_col: str = "id") -> DataFrame:
        """id, code, error, cell of each vector of the fitted length; to be written, by cell if queries are few."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, at = _matrix(batch.column("embedding"), shared.value.size)
                if len(x):
                    cell, code, error = shared.value.encode(x)
                    blobs = pa.array([c.tobytes() for c in code], pa.binary())
                    yield pa.record_batch({"id": batch.column("id").take(pa.array(at)), "code": blobs, "error": pa.array(error, pa.float32()), "cell": pa.array(cell, pa.int32())})

        return rows.where(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), "embedding").mapInArrow(run, CODES)

    def bounds(self, batch: pa.RecordBatch, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Query, rows of the batch, lower and upper bounds of their distances, cell by cell."""
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        error = batch.column("error").to_numpy(zero_copy_only=False).astype(np.float64)
        for k in np.unique(cell):
            rows = np.flatnonzero(cell == k)
            flat = np.ascontiguousarray(code[rows].T).astype(np.int64) + np.arange(len(self.entries))[:, None] * self.entries.shape[1]
            of_query = self.pieces(queries - self.cells.centres[k])
            tables = ((of_query[:, :, None, :] - self.entries[:, None]) ** 2).sum(axis=3).transpose(1, 0, 2).reshape(len(queries), -1)
            for q, table in enumerate(tables):
                far = np.sqrt(np.take(table, flat, mode="clip").sum(axis=0))
                yield q, rows, far - error[rows], far + error[rows]


def nearest_by_codes(books: Codebooks, codes: DataFrame, rows: DataFrame, queries: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """query_id, id, distance, rank of the ``limit`` nearest ``rows`` (id, embedding) of each query (query_id, embedding), equal distances by id: exactly.

    ``codes`` are those of ``rows``, and are read twice for each ``QUERY_BLOCK`` queries; of ``rows`` only the vectors of candidates are measured. Queries without a vector of the fitted length find nothing.
    """
    spark, out, block = rows.sparkSession, None, []
    vector_of = rows.select(F.col(id_col).cast("long").alias("id"), vectors.as_double(F.col("embedding")).alias("embedding"))

    def against(block: list) -> DataFrame:
        asked = np.array([q for _, q in block])
        shared = spark.sparkContext.broadcast((books, asked))

        def uppers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, asked = shared.value
            best = np.full((len(asked), limit), np.inf)
            for batch in batches:
                if batch.num_rows:
                    for q, _, _, upper in books.bounds(batch, asked):
                        best[q] = np.sort(np.concatenate([best[q], np.partition(upper, min(limit, len(upper)) - 1)[:limit]]))[:limit]
            q, place = np.nonzero(np.isfinite(best))
            yield pa.record_batch({"q": pa.array(q, pa.int32()), "upper": pa.array(best[q, place])})

        least = F.row_number().over(W.partitionBy("q").orderBy("upper"))
        reach = codes.mapInArrow(uppers, "q int, upper double").withColumn("n", least).where(F.col("n") <= limit).groupBy("q").agg(F.max("upper").alias("reach"), F.count(F.lit(1)).alias("n"))
        limits = np.full(len(block), np.inf)
        for r in reach.where(F.col("n") == limit).collect():  # one a query
            limits[r["q"]] = r["reach"]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, asked = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = [(np.full(len(hit), q), rows[hit]) for q, rows, lower, _ in books.bounds(batch, asked) if len(hit := np.flatnonzero(lower <= limits[q]))]
                if found:
                    q, at = (np.concatenate(x) for x in zip(*found))
                    yield pa.record_batch({"q": pa.array(q, pa.int32()), "id": batch.column("id").take(pa.array(at))})

        candidates = codes.mapInArrow(near, "q int, id long")
        named = spark.createDataFrame([(i, name, q.tolist()) for i, (name, q) in enumerate(block)], f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}, asked array<double>")
        pairs = candidates.join(vector_of, "id").join(F.broadcast(named), "q")
        return pairs.select("query_id", "id", vectors.l2_distance(F.col("embedding"), F.col("asked")).alias("distance"))

    for r in queries.where(F.col("embedding").isNotNull()).select("query_id", vectors.as_double(F.col("embedding")).alias("embedding")).toLocalIterator():
        if len(r["embedding"]) == books.size and None not in r["embedding"]:
            block.append((r["query_id"], np.array(r["embedding"])))
        if len(block) == QUERY_BLOCK:
            out, block = (against(block) if out is None else out.unionByName(against(block))), []
    if block:
        out = against(block) if out is None else out.unionByName(against(block))
    if out is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id long, distance double, rank int")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= limit)
