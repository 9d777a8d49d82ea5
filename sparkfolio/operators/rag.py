"""What surrounds a model call in question answering: context, citations, message windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors

#: Turns of a conversation that a model is shown: ten questions with their answers.
MESSAGES = 20
ELEMENTS, LEAST_ELEMENTS, EXTRA_CHUNKS = 8, 4, 4


def tag(rank: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("]"))


def _is_element() -> Column:
    return (F.col("source_type") == "element") & (F.coalesce(F.col("element_type"), F.lit("")) != "")


def _named() -> Column:
    return F.concat(F.upper("element_type"), F.lit(": "), F.coalesce("element_label", F.lit("")))


def _joined(lines: DataFrame, line: Column, by: list[str], rank: str, between: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("n"), line.alias("s"))))
    return lines.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), between).alias("text"))


def context(results: DataFrame, by: list[str] = (), rank: str = "rank") -> DataFrame:
    """``text`` for a model: each result's tag, kind, place and the first 500 characters. Results are few by their limit."""
    where = F.concat(F.lit("(from "), "document_title", F.lit(", page "), F.col("page_number").cast("string"), F.lit(")\n    "), F.coalesce(F.left("content", F.lit(500)), F.lit("")))
    line = F.concat(tag(F.col(rank)), F.lit(" "), F.when(_is_element(), _named()).otherwise("TEXT"), F.lit(" "), where)
    return _joined(results, line, list(by), rank, "\n\n")


def sources(results: DataFrame, by: list[str] = (), rank: str = "rank", percent: bool = True) -> DataFrame:
    """``text``: one line for each result. Percentages are rounded half to even."""
    score = F.concat(F.lit(" | "), F.bround(vectors.score_percent(F.col("score")), 0).cast("int").cast("string"), F.lit("%")) if percent else F.lit("")
    line = F.concat(tag(F.col(rank)), F.lit(" "), F.when(_is_element(), _named()).otherwise("TEXT chunk"), F.lit(" | "), "document_title", F.lit(" p."), F.col("page_number").cast("string"), score)
    return _joined(results, line, list(by), rank, "\n")


def followups(conversations: DataFrame) -> DataFrame:
    """Questions with the query each becomes after the question before it in its conversation."""
    questions = conversations.where(F.col("role") == "user")
    last = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return questions.withColumn("query", text.expand_followup(F.col("text"), last))


def message_window(conversations: DataFrame, messages: int = MESSAGES) -> DataFrame:
    """Each turn with the messages up to it that a model is shown."""
    seen = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-(messages - 1), 0)
    return conversations.withColumn("window", F.collect_list(F.struct("role", "text")).over(seen))


def chat_results(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """Elements, and where they are few up to four chunks after them, numbered by ``rank``. Both come limited."""
    few = elements.agg((F.count(F.lit(1)) < LEAST_ELEMENTS).alias("few"))
    more = chunks.where(F.col("source_type") == "chunk").orderBy("score", "id").limit(EXTRA_CHUNKS).crossJoin(few).where("few").drop("few")
    both = elements.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("rank", F.row_number().over(W.orderBy("part", "score", "id"))).drop("part")
