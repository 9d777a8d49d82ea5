"""A written inverted index with block maxima, for the best rows by lexical rank.

The postings of a lexeme are cut into blocks by ranges of ids, the same ranges for all lexemes. A block has the ids as distances from the range's start, the places of the lexeme
in each row, and how many places a row has at most. From the last alone, a range's rank is bounded for a query: ranges that can't hold one of the best rows
are never expanded, and ranges that lack a lexeme don't even come up. Each ingestion writes a segment of its own, a deletion a list of ids; ``compact`` makes one segment of all.
"""

from __future__ import annotations

import uuid
from math import exp, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import best_first
from ..functions.positions import ALL_SQUARES, RANK_DIGITS, WEIGHT, ranks_of_places
from ..sources.versions import Versions

#: Ids of a range (as a power of two), folders that lexemes are dealt to, and ranges that are looked at before the rest is bounded.
RANGE_BITS, LEXEME_PARTS, FIRST = 12, 256, 8
#: What a pair of places is worth at most: two lexemes are one place apart at least.
PAIR = sqrt(WEIGHT * WEIGHT / (1.005 + 0.05 * exp(1 / 1.5 - 2)))
BLOCK = "lexeme string, range long, rows int, most int, ids array<smallint>, places array<array<smallint>>, segment string, lexeme_part int"


def lexeme_part(lexeme: Column) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(LEXEME_PARTS)).cast("int")


def bound_of(lexemes: int) -> Column:
    """No row of a range ranks higher, by the aggregates ``total`` and ``squares`` of its blocks' ``most``."""
    if lexemes == 1:
        return F.aggregate(F.sequence(F.lit(1), F.col("total").cast("int")), F.lit(0.0), lambda s, j: s + 1 / (j.cast("double") * j)) * (WEIGHT / ALL_SQUARES)
    return 1 - F.pow(F.lit(1 - PAIR), (F.col("total") * F.col("total") - F.col("squares")) / 2)


class PostingIndex:
    """Segments and lists of deleted ids under a folder, in the order in which they came. A deletion holds for the segments before it, so an id may come again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def _blocks(self, postings: DataFrame) -> DataFrame:
        """Blocks of (lexeme, id, places), at most a range of ids each."""
        ranged = postings.withColumn("range", F.shiftright("id", RANGE_BITS))
        row = F.struct((F.col("id") - F.shiftleft("range", RANGE_BITS)).cast("smallint").alias("id"), F.col("places").cast("array<smallint>").alias("places"))
        found = ranged.groupBy("lexeme", "range").agg(F.sort_array(F.collect_list(row)).alias("r"), F.max(F.size("places")).alias("most"))
        return found.select("lexeme", "range", F.size("r").alias("rows"), "most", F.col("r.id").alias("ids"), F.col("r.places").alias("places"), lexeme_part(F.col("lexeme")).alias("lexeme_part"))

    def _write(self, postings: DataFrame, segment: str) -> None:
        blocks = self._blocks(postings)
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # By range, so that a frequent lexeme is spread over tasks and a task writes to few folders.
        dealt = blocks.repartitionByRange(width, "lexeme_part", "lexeme", "range").sortWithinPartitions("lexeme_part", "lexeme", "range")
        dealt.write.partitionBy("lexeme_part").option("compression", "zstd").parquet(f"{self.versions.root}/segment={segment}")

    def add(self, rows: DataFrame, id_col: str = "id", vector: str = "tsv") -> None:
        """A segment of rows with position vectors; their ids must not be there, but for deleted ones. Rows with a null id or vector are left out."""
        segment = f"s-{uuid.uuid4().hex}"
        entries = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(vector).alias("e"))
        self._write(entries.select("e.lexeme", "id", F.col("e.positions").alias("places")), segment)
        self.versions.commit(lambda parts: [*parts, segment])

    def delete(self, ids: DataFrame, id_col: str = "id") -> None:
        name = f"d-{uuid.uuid4().hex}"
        ids.select(F.col(id_col).cast("long").alias("id")).distinct().write.parquet(f"{self.versions.root}/{name}")
        self.versions.commit(lambda parts: [*parts, name])

    def _read(self, parts: list[str], lexeme_parts: list[int] | None = None) -> DataFrame:
        """Blocks with ``at``, the place of their segment in the order; of some folders of lexemes only, so that no others are even listed."""
        segments = {p: i for i, p in enumerate(parts) if p.startswith("s-")}
        folders = [f"segment={p}" if lexeme_parts is None else f"segment={p}/lexeme_part={k}" for p in segments for k in lexeme_parts or [0]]
        folders = [f"{self.versions.root}/{f}" for f in folders if self.versions.exists(f)]
        if not folders:
            return self.spark.createDataFrame([], BLOCK + ", at int")
        order = F.create_map(*[F.lit(x) for p in segments.items() for x in p])
        return self.spark.read.schema(BLOCK).option("basePath", self.versions.root).parquet(*folders).withColumn("at", order[F.col("segment")])

    def _alive(self, rows: DataFrame, parts: list[str]) -> DataFrame:
        """Rows (id, at) that no later deletion names."""
        gone = None
        for i, p in enumerate(parts):
            if p.startswith("d-"):
                one = self.spark.read.schema("id long").parquet(f"{self.versions.root}/{p}").withColumn("gone_at", F.lit(i))
                gone = one if gone is None else gone.unionByName(one)
        if gone is None:
            return rows
        gone = gone.groupBy("id").agg(F.max("gone_at").alias("gone_at"))
        return rows.join(gone, "id", "left").where(F.col("gone_at").isNull() | (F.col("gone_at") < F.col("at"))).drop("gone_at")

    @staticmethod
    def _rows(blocks: DataFrame) -> DataFrame:
        """at, id, lexeme, places of each posting."""
        one = F.explode(F.arrays_zip("ids", "places")).alias("r")
        return blocks.select("at", "lexeme", "range", one).select("at", "lexeme", (F.shiftleft("range", RANGE_BITS) + F.col("r.ids")).alias("id"), F.col("r.places").alias("places"))

    def compact(self) -> None:
        """One segment of all, without what was deleted. Segments that come meanwhile stay beside it."""
        before = self.versions.parts()
        segment = f"s-{uuid.uuid4().hex}"
        self._write(self._alive(self._rows(self._read(before)), before).select("lexeme", "id", "places"), segment)
        self.versions.commit(lambda parts: [segment, *parts[len(before) :]] if parts[: len(before)] == before else parts)

    def search(self, lexemes: list[str], limit: int, first: int = FIRST) -> DataFrame:
        """id and rank of the ``limit`` best rows that have all lexemes, equal ranks by id: what ranking every row gives.

        Ranks are compared in ``RANK_DIGITS``. No lexeme matches no row. The ``first`` ranges with the highest bounds give the rank that any other range must reach.
        """
        lexemes = sorted(set(lexemes))
        parts = self.versions.parts()
        if not lexemes:
            return self.spark.createDataFrame([], "id long, rank double")
        wanted = self.spark.range(1).select(F.array(*[lexeme_part(F.lit(x)) for x in lexemes])).first()[0]
        blocks = self._read(parts, sorted(set(wanted))).where(F.col("lexeme").isin(lexemes))
        total = F.sum(F.col("most").cast("double"))
        ranges = blocks.groupBy("at", "range").agg(F.count(F.lit(1)).alias("lexemes"), total.alias("total"), F.sum(F.col("most").cast("double") * F.col("most")).alias("squares"))
        ranges = ranges.where(F.col("lexemes") == len(lexemes)).select("at", "range", bound_of(len(lexemes)).alias("bound"))
        best = ranges.orderBy(F.desc("bound"), "at", "range").limit(first).collect()
        if not best:
            return self.spark.createDataFrame([], "id long, rank double")

        def ranked(of: DataFrame) -> DataFrame:
            rows = self._rows(blocks.join(of, ["at", "range"], "left_semi")).groupBy("at", "id").agg(F.collect_list("places").alias("places"))
            rows = self._alive(rows.where(F.size("places") == len(lexemes)), parts)
            return rows.select("id", F.arrow_udf(ranks_of_places, "double")("places").alias("rank")).orderBy(*best_first()).limit(limit)

        some = self.spark.createDataFrame([(r["at"], r["range"]) for r in best], "at int, range long")
        found = ranked(F.broadcast(some)).collect()
        least = found[-1]["rank"] - 2 * 10.0**-RANK_DIGITS if len(found) == limit else 0.0  # ranks and bounds are rounded
        rest = ranges.where(F.col("bound") >= least).join(F.broadcast(some), ["at", "range"], "left_anti")
        out = self.spark.createDataFrame([tuple(r) for r in found], "id long, rank double").unionByName(ranked(rest)).orderBy(*best_first()).limit(limit)
        out._ranges = (ranges, len(best), rest)
        return out
