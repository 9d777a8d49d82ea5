"""Ingestion: policies for documents that are there already, ids, cascades and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .chunking import chunk_pages
from .numbering import running_number


class DuplicateDocument(ValueError):
    """A new document has the slug or source file of one that is there."""


def existing(new: DataFrame, documents: DataFrame) -> DataFrame:
    """New documents whose slug or source file is there already."""
    by_slug = new.join(documents.select("slug").distinct(), "slug", "left_semi")
    by_file = new.join(documents.select("slug").distinct(), "slug", "left_anti").join(documents.select("source_file").distinct(), "source_file", "left_semi")
    return by_slug.unionByName(by_file)


def skip_existing(new: DataFrame, documents: DataFrame) -> DataFrame:
    """Only the documents whose slug and source file are both new."""
    return new.join(documents.select("slug").distinct(), "slug", "left_anti").join(documents.select("source_file").distinct(), "source_file", "left_anti")


def require_new(new: DataFrame, documents: DataFrame) -> DataFrame:
    found = existing(new, documents).select("slug").limit(5).collect()
    if found:
        raise DuplicateDocument("already there: " + ", ".join(r["slug"] for r in found))
    return new


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """documents, pages, chunks and elements without the documents of ``gone`` (slug); unknown slugs do nothing."""
    documents = tables["documents"]
    ids = documents.join(gone.select("slug").distinct(), "slug", "left_semi").select(F.col("id").alias("document_id"))
    out = {"documents": documents.join(ids.withColumnRenamed("document_id", "id"), "id", "left_anti")}
    return out | {k: t.join(ids, "document_id", "left_anti") for k, t in tables.items() if k != "documents"}


def normalized_elements(elements: DataFrame) -> DataFrame:
    """As they are stored: short labels, empty texts for missing ones, no empty vectors."""
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("search_text", "latex", "rendered_path")}
    return elements.withColumns(empty | {"label": F.coalesce(F.left(F.col("label"), F.lit(100)), F.lit("")), "embedding": F.when(F.size("embedding") > 0, F.col("embedding"))})


def with_ids(rows: DataFrame, order: str, after: int = 0) -> DataFrame:
    """``id`` by an integer column, following on ``after``."""
    return running_number(rows.withColumn("__all", F.lit(1)), ["__all"], [order], "id", start=after + 1, kind="long").drop("__all")


def dry_run(pages: DataFrame, elements: DataFrame, by: str = "document_id") -> DataFrame:
    """What an ingestion would add: pages, chunks, elements of each document."""
    chunks = chunk_pages(pages).groupBy(by).agg(F.count(F.lit(1)).alias("chunks"))
    return (
        pages.groupBy(by).agg(F.count(F.lit(1)).alias("pages"))
        .join(chunks, by, "left")
        .join(elements.groupBy(by).agg(F.count(F.lit(1)).alias("elements")), by, "left")
        .na.fill(0, ["chunks", "elements"])
    )


def violations(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that should be unique and are not, with their counts."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def summary_input(pages: DataFrame, summary: str, by: str = "document_id", order: str = "page_number", most: int = 8000, true_numbers: bool = False) -> DataFrame:
    """Page summaries of a document, one ``Page i: …`` line each, cut at ``most`` characters.

    Pages without a summary are left out. i counts the summaries, as the model was always shown it, unless ``true_numbers`` is set.
    """
    kept = pages.where(F.length(summary) > 0).select(by, F.col(order).alias("n"), F.left(summary, F.lit(most + 1)).alias("s"))
    # A line has nine characters at least, so later pages than these are never shown and a group stays small.
    kept = running_number(kept, [by], ["n", "s"], "i", start=1).where(F.col("i") <= most // 9 + 1)
    listed = F.sort_array(F.collect_list(F.struct("i", "n", "s")))
    number = "n" if true_numbers else "i"
    text = F.array_join(F.transform(listed, lambda x: F.concat(F.lit("Page "), x[number].cast("string"), F.lit(": "), x["s"])), "\n")
    out = kept.groupBy(by).agg(text.alias("text"))
    return out.withColumn("text", F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit("\n..."))).otherwise(F.col("text")))


def first_last_text(pages: DataFrame, text: str, by: str = "document_id", order: str = "page_number") -> DataFrame:
    return pages.groupBy(by).agg(F.min_by(text, order).alias("first_text"), F.max_by(text, order).alias("last_text"))


def worth_summary(text: Column, least: int = 100) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= least


def progress(extracted: DataFrame, totals: DataFrame, by: str = "document_id") -> DataFrame:
    """Documents with ``extracted``, ``total`` and whether all pages are there."""
    done = extracted.groupBy(by).agg(F.count_distinct("page_number").alias("extracted"))
    out = totals.join(done, by, "left").na.fill(0, ["extracted"])
    return out.withColumn("complete", F.col("extracted") >= F.col("total"))
