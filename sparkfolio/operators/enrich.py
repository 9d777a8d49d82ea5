"""Enrichment by a text model: search texts of elements, summaries and keywords of pages and documents, licenses.

Everything around the model call is native; a call runs only for rows that need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ingest import first_last_text, summary_input, worth_summary
from .providers import Generator, generate_column

PAGE_TEXT, ELEMENT_TEXT = 4000, 3000
PAGE_KEYWORDS, DOCUMENT_KEYWORDS = 8, 10


def missing(column: str):
    return F.coalesce(F.length(F.col(column)), F.lit(0)) == 0


def enrich_elements(elements: DataFrame, generator: Generator, page_text: str = "full_text", skip_existing: bool = True, **more) -> DataFrame:
    """``search_text`` of elements from their description and page; a failed call leaves what was there."""
    prompt = F.concat(
        F.lit("Describe in a few sentences, for search, this "), F.coalesce("element_type", F.lit("element")), F.lit(" labelled "), F.coalesce("label", F.lit("Unknown")),
        F.lit(".\nDescription: "), F.coalesce("description", F.lit("")), F.lit("\nText of its page:\n"), F.coalesce(F.left(page_text, F.lit(ELEMENT_TEXT)), F.lit("")),
    )
    asked = generate_column(elements.withColumn("__prompt", prompt), "__prompt", generator, "__answer", missing("search_text") if skip_existing else None, **more)
    answer = F.nullif(text.strip_think_tags(text.strip(F.col("__answer"))), F.lit(""))
    return asked.withColumn("search_text", F.coalesce(answer, "search_text")).drop("__prompt", "__answer")


def _summarized(rows: DataFrame, generator: Generator, where, keywords: int, **more) -> DataFrame:
    asked = generate_column(rows, "__prompt", generator, "__answer", where, **more)
    answer = text.strip_think_tags(text.strip(F.col("__answer")))
    found = F.nullif(text.summary_of(answer), F.lit(""))
    columns = {"summary": F.coalesce(found, "summary"), "keywords": F.when(found.isNotNull(), text.keywords_of(answer, keywords)).otherwise(F.col("keywords"))}
    return asked.withColumns(columns).drop("__prompt", "__answer")


def summarize_pages(pages: DataFrame, generator: Generator, skip_existing: bool = True, **more) -> DataFrame:
    """``summary`` and ``keywords`` of pages with at least 100 characters of text."""
    prompt = F.concat(F.lit("Answer with SUMMARY: and KEYWORDS: for this page.\n"), F.left("full_text", F.lit(PAGE_TEXT)))
    where = worth_summary(F.col("full_text"))
    return _summarized(pages.withColumn("__prompt", prompt), generator, where & missing("summary") if skip_existing else where, PAGE_KEYWORDS, **more)


def summarize_documents(documents: DataFrame, pages: DataFrame, generator: Generator, skip_existing: bool = True, **more) -> DataFrame:
    """``summary`` and ``keywords`` of documents from their pages' summaries."""
    joined = summary_input(pages, "summary").select(F.col("document_id").alias("id"), F.col("text").alias("__pages"))
    prompt = F.concat(F.lit("Answer with SUMMARY: and KEYWORDS: for the document "), F.coalesce("title", F.lit("")), F.lit(".\n"), "__pages")
    where = F.col("__pages").isNotNull()
    rows = documents.join(joined, "id", "left").withColumn("__prompt", prompt)
    return _summarized(rows, generator, where & missing("summary") if skip_existing else where, DOCUMENT_KEYWORDS, **more).drop("__pages")


def extract_licenses(documents: DataFrame, pages: DataFrame, generator: Generator, skip_existing: bool = True, **more) -> DataFrame:
    """``license`` of documents from the first and last page."""
    ends = first_last_text(pages, "full_text").select(F.col("document_id").alias("id"), text.license_input(F.col("first_text"), F.col("last_text")).alias("__ends"))
    rows = documents.join(ends, "id", "left").withColumn("__prompt", F.concat(F.lit("Name the license this document states, or NONE.\n"), "__ends"))
    asked = generate_column(rows, "__prompt", generator, "__answer", missing("license") if skip_existing else None, **more)
    return asked.withColumn("license", F.coalesce(text.license_of(F.col("__answer")), "license")).drop("__prompt", "__answer", "__ends")


def enrichment_stats(pages: DataFrame, elements: DataFrame, by: str = "document_id") -> DataFrame:
    """Per document: elements and those with search text, pages, those with a summary and those too short for one."""
    of_elements = elements.groupBy(by).agg(F.count(F.lit(1)).alias("elements"), F.count_if(~missing("search_text")).alias("elements_enriched"))
    of_pages = pages.groupBy(by).agg(F.count(F.lit(1)).alias("pages"), F.count_if(~missing("summary")).alias("pages_summarized"), F.count_if(~worth_summary(F.col("full_text"))).alias("pages_short"))
    return of_pages.join(of_elements, by, "full").na.fill(0)


def extraction_stats(pages: DataFrame, by: str = "document_id") -> DataFrame:
    """Pages and average seconds of extraction, to two places."""
    return pages.groupBy(by).agg(F.count(F.lit(1)).alias("pages"), F.bround(F.avg("extraction_time_seconds"), 2).alias("avg_seconds"))
