"""Row numbers within groups, without sorting a large group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Consecutive values of the leading order column that are numbered together.
WIDTH = 4096


def running_number(rows: DataFrame, groups: list[str], order: list[str], name: str, start: int = 1, width: int = WIDTH, kind: str = "int") -> DataFrame:
    """``row_number`` of each row in its group by ``order``, whose first column is an integer.

    A group is numbered in stretches of that column, and the stretches' sizes are summed up; so one that
    holds most of the rows is spread over tasks. Numbers over all rows of a corpus need ``kind`` long.
    """
    rows = rows.withColumn("__part", F.floor(F.col(order[0]) / width))
    sizes = rows.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*groups, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    number = F.row_number().over(W.partitionBy(*groups, "__part").orderBy(*order))
    numbered = rows.withColumn("__k", number)
    same = [numbered[g].eqNullSafe(sizes[g]) for g in groups] + [numbered["__part"].eqNullSafe(sizes["__part"])]
    kept = [numbered[c] for c in rows.columns if c != "__part"]
    return numbered.join(sizes, same).select(*kept, (F.col("__k") + F.col("__before") + (start - 1)).cast(kind).alias(name))
