"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Each source has a word budget. Whole repeats of the source come first; the rest of the budget is
met by the documents whose hash lies under a threshold. The threshold comes from histograms:
words are summed by source and hash bucket, the bucket where the running sum crosses the budget
is found, and only that bucket is summed again by the next bits of the hash. Nothing is sorted,
thresholds are nested (a larger budget keeps all that a smaller one took), and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVELS = 4
LEVEL_BITS = 10
WORD = r"[^\x20\x09-\x0D]+"


def hash40(col: Column) -> Column:
    """40 evenly spread bits of an id, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 10), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target of each source of (source, size).

    Weights repeat over the sources by code point, null last. The budgets share the sum of all
    sizes; one over ``max_repeats`` times its source stops there and the excess is shared anew.
    With sources ordered by size over weight, those that stop are the ones at the front, so one
    pass of running sums replaces the rounds of sharing. It works on one row per source.
    """
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1).cast("long")
    source = source.withColumn("weight", weight)
    cap = F.col("source_size") * max_repeats
    before = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    source = source.withColumns(
        {
            "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    stops = cap * F.col("left_weight") <= F.col("left_words") * F.col("weight")
    # The share per weight that is left once all that stop have stopped: the first row that doesn't.
    level = F.max(F.when(~stops, F.struct("left_weight", "left_words"))).over(everything)
    share = level["left_words"].cast("double") / level["left_weight"].cast("double")
    return source.withColumn("target", F.when(stops, cap.cast("double")).otherwise(F.col("weight") * share)).select("source", "source_size", "target")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def thresholds(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """s (source), source_size, target, repeats, under: every document of a source is taken ``repeats`` times, and those with a hash below ``under`` once more.

    ``sized`` has source, size and h (``hash40`` of the id), and is read again for each level.
    """
    targets = source_targets(sized, weights)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("repeats", repeats)
    targets = materialise(targets.withColumn("want", F.col("target") - F.col("repeats") * F.col("source_size")))

    # found: by source, the hash prefix of the boundary bucket and what the buckets before it hold.
    zero = F.lit(0).cast("long")
    found = targets.select(F.col("source").alias("s"), "want", zero.alias("prefix"), zero.alias("below"), zero.alias("inside"))
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * LEVEL_BITS
        inside = sized.filter("size > 0").join(found.drop("inside"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        bins = inside.groupBy("s", "want", "below", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("inside"))
        running = F.sum("inside").over(W.partitionBy("s").orderBy("prefix"))
        bins = bins.withColumn("below", F.col("below") + running - F.col("inside"))
        edge = F.max_by(F.struct("want", "prefix", "below", "inside"), "prefix")
        bins = bins.filter(F.col("below") <= F.col("want")).groupBy("s").agg(edge.alias("edge"))
        found = materialise(bins.select("s", "edge.*"))
    # The last bucket goes in if that comes nearer to the budget.
    last = F.col("want") - F.col("below") >= F.col("below") + F.col("inside") - F.col("want")
    found = found.select(F.col("s").alias("f"), F.when(last, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("under"))
    targets = targets.join(found, F.col("source").eqNullSafe(F.col("f")), "left")
    return materialise(targets.select(F.col("source").alias("s"), "source_size", "target", "repeats", F.coalesce("under", zero).alias("under")))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), hash40(F.col(id_col)).alias("h")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, times.

    ``taken`` is ``times`` (0 to 3) the size. A source's sum of taken words differs from its target by half of the boundary
    document's size at most (documents of equal hash count as one). Null text has size 0; null sources form a
    source of their own; rows that repeat an id are taken together; an empty table gives no rows.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    out = sized.join(thresholds(sized, weights), F.col("source").eqNullSafe(F.col("s")))
    times = F.col("repeats") + (F.col("h") < F.col("under")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it, with all columns of ``docs``, whatever their names.

    Nulls, repeated ids, ties and empty tables as in ``mix``.
    """
    source, repeats, under, taken, time = (free_name(docs, f"mix_{x}") for x in ("source", "repeats", "under", "taken", "time"))
    limits = thresholds(_sized(docs, id_col, text_col, source_col), weights)
    limits = limits.select(F.col("s").alias(source), F.col("repeats").alias(repeats), F.col("under").alias(under))
    times = F.col(repeats) + (hash40(docs[id_col]) < F.col(under)).cast("long")
    out = docs.join(limits, docs[source_col].eqNullSafe(F.col(source))).withColumn(taken, times).filter(F.col(taken) > 0)
    return out.withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), F.col(taken)))).select(*[F.col(f"`{c}`") for c in docs.columns])
