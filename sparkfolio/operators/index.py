"""Side tables that make searches cheaper: word postings, and vector cells for approximate neighbours.

Searches are exact without them. Postings answer word queries from the rows of the query's words alone. Cells keep
to the nearest few of the corpus; their recall is measured against the exact search in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.lexical import best_first
from ..functions.positions import ranks_of_places
from .batch_search import Best, distances

#: Vectors that cell centres are fitted on, chosen by hash; every vector is assigned to a cell.
SAMPLE, ROUNDS = 20_000, 12
#: Queries that look into cells at a time.
QUERY_BLOCK = 4096


def postings(rows: DataFrame, id_col: str = "id", vector: str = "tsv") -> DataFrame:
    """lexeme, id, positions. Written partitioned by ``lexeme_part``, a query reads only the parts of its words."""
    out = rows.select(F.col(id_col).alias("id"), F.explode(vector).alias("e")).select("e.lexeme", "id", "e.positions")
    return out.withColumn("lexeme_part", F.pmod(F.xxhash64("lexeme"), F.lit(256)).cast("int"))


def match_postings(table: DataFrame, lexemes: list[str], limit: int) -> DataFrame:
    """id and rank of the best rows that have all lexemes."""
    lexemes = sorted(set(lexemes))
    if not lexemes:
        return table.select("id", F.lit(0.0).alias("rank")).limit(0)
    part_of = lambda x: F.pmod(F.xxhash64(x), F.lit(256)).cast("int")
    wanted = table.sparkSession.range(1).select(F.array(*[part_of(F.lit(x)) for x in lexemes])).first()[0]
    found = table.where(F.col("lexeme_part").isin(wanted) & F.col("lexeme").isin(lexemes))
    found = found.groupBy("id").agg(F.collect_list("positions").alias("places")).where(F.size("places") == len(lexemes))

    score = F.arrow_udf(ranks_of_places, "double")
    return found.select("id", score("places").alias("rank")).orderBy(*best_first()).limit(limit)


@dataclass
class Cells:
    """Centres of cells; a vector belongs to the nearest."""

    centres: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS, id_col: str = "id") -> Cells:
        picked = rows.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample)
        x = np.array([r["embedding"] for r in picked.select("embedding").collect()], np.float64)
        rng = np.random.default_rng(0)
        centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((1, 1))
        for _ in range(rounds if len(x) else 0):
            near = cls(centres).nearest(x, 1)[:, 0]
            centres = np.array([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        return cls(centres)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the nearest cells of each vector, the nearest first."""
        d = (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def assign(self, rows: DataFrame, n: int = 1, name: str = "cell") -> DataFrame:
        """Rows with their cell, or, for n over 1, once for each of their nearest cells."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("array<int>")
        def cells(part: pa.Array) -> pa.Array:
            near = shared.value.nearest(_vectors(part), n).astype(np.int32) if len(part) else np.zeros((0, 1), np.int32)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * near.shape[1], pa.int32()), pa.array(near.reshape(-1)))

        return rows.where(F.col("embedding").isNotNull()).withColumn(name, F.explode(cells(F.col("embedding"))))


def _vectors(part: pa.Array) -> np.ndarray:
    return np.asarray(part.flatten(), np.float64).reshape(len(part), -1)


def _nearest_in_cells(shared, limit: int):
    """Each task's nearest rows of each query among the cells it may look at, and no farther than its reach: a matrix product for the rows of a cell in a batch and the queries that look there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, may, reach = shared.value
        best = Best(len(names), limit)
        best.key[:] = reach[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, cell = _vectors(batch.column("embedding")), *(batch.column(c).to_numpy().astype(np.int64) for c in ("id", "cell"))
            order = np.argsort(cell, kind="stable")
            x, ids, cell = x[order], ids[order], cell[order]
            starts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for a, b in zip(starts, starts[1:]):
                of = np.flatnonzero(may[:, cell[a]])
                q, rows = asked[of], x[a:b]
                rough = (q * q).sum(axis=1)[:, None] + (rows * rows).sum(axis=1) - 2 * q @ rows.T
                for i, v, near in zip(of, q, rough):
                    some, d = distances(rows, v, near, best.key[i, -1], limit)
                    if len(some):
                        best.offer(i, d, ids[a:b][some], np.zeros(len(some), np.int64))
        query, place = np.nonzero(best.row >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(best.id[query, place]), pa.array(best.key[query, place])], ["query_id", "id", "distance"])

    return run


def near_join(indexed: DataFrame, cells: Cells, queries: DataFrame, limit: int, probe: int = 8, exact: bool = False) -> DataFrame:
    """query_id, id, distance, rank of the ``limit`` nearest rows among each query's ``probe`` nearest cells.

    ``exact`` goes on to every cell that may hold a nearer row: whose centre is no farther from the query than the ``limit``-th distance so far and the farthest of its rows together.
    Queries go out in blocks; what is shuffled grows with queries and tasks, not with pairs.
    """
    spark, kind, found, block = indexed.sparkSession, "query_id long, id long, distance double", None, []
    rows = indexed.select(F.col("id").cast("long").alias("id"), "embedding", "cell")
    order = W.partitionBy("query_id").orderBy("distance", "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    radius = None
    if exact:
        shared_cells = spark.sparkContext.broadcast(cells)

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.full(len(cells.centres), -np.inf)
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                np.maximum.at(out, cell, np.sqrt(((_vectors(batch.column("embedding")) - shared_cells.value.centres[cell]) ** 2).sum(axis=1))) if len(cell) else None
            yield pa.record_batch({"cell": pa.array(np.arange(len(out)), pa.int32()), "far": pa.array(out)})

        radius = np.full(len(cells.centres), -np.inf)
        for r in rows.select("embedding", "cell").mapInArrow(far, "cell int, far double").groupBy("cell").agg(F.max("far").alias("radius")).collect():
            radius[r["cell"]] = r["radius"]

    def against(block: list) -> DataFrame:
        names, asked = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
        may = np.zeros((len(block), len(cells.centres)), bool)
        np.put_along_axis(may, cells.nearest(asked, probe), True, axis=1)
        look = lambda may, reach: rows.mapInArrow(_nearest_in_cells(spark.sparkContext.broadcast((names, asked, may, reach)), limit), kind)
        best = ranked(look(may, np.full(len(block), np.inf)))
        if not exact:
            return best.drop("rank")
        best = best.collect()  # ``limit`` rows for each query of the block
        at, reach = {n: i for i, n in enumerate(names.tolist())}, np.full(len(block), np.inf)
        for r in best:
            if r["rank"] == limit:
                reach[at[r["query_id"]]] = r["distance"]
        gap = np.sqrt(((asked[:, None] - cells.centres) ** 2).sum(axis=2)) - radius * (1 + 1e-9) - 1e-9
        first = spark.createDataFrame([tuple(r)[:3] for r in best], kind)
        return first.unionByName(look(~may & (gap <= reach[:, None]) & (radius >= 0), reach))

    for r in queries.where(F.col("embedding").isNotNull()).select("query_id", vectors.as_double(F.col("embedding")).alias("embedding")).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            found, block = against(block) if found is None else found.unionByName(against(block)), []
    if block:
        found = against(block) if found is None else found.unionByName(against(block))
    return ranked(spark.createDataFrame([], kind) if found is None else found)
