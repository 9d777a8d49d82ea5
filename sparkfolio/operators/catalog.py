"""Listings, counts, finders and lookups over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT_TYPES = ("figure", "table", "equation", "chart", "diagram")


def page_counts(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with ``page_count``, 0 where there are none. Pages are counted before the join, so it never fans out."""
    counts = pages.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("page_count"))
    return documents.join(counts, "id", "left").na.fill(0, ["page_count"])


def _order(sort: str) -> list[Column]:
    first = {"date": F.desc_nulls_last("extraction_date"), "page_count": F.desc("page_count")}.get(sort, F.asc_nulls_last("title"))
    return [first, F.asc("slug")]


def list_documents(documents: DataFrame, pages: DataFrame, page: int = 1, page_size: int = 20, sort: str = "title") -> DataFrame:
    """One page of documents by title, date or page count; another sort means title. Numbers out of range are brought into it."""
    page, page_size = max(1, page), min(max(1, page_size), 100)
    return page_counts(documents, pages).orderBy(*_order(sort)).offset((page - 1) * page_size).limit(page_size)


def page_total(rows: DataFrame, page_size: int) -> DataFrame:
    """total rows and total_pages."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.ceil(n / page_size).alias("total_pages"))


def type_counts(elements: DataFrame, by: str = "document_id") -> DataFrame:
    """A count for each known element type; unknown types are in none."""
    return elements.groupBy(by).agg(*[F.count_if(F.col("element_type") == t).alias(f"{t}s") for t in ELEMENT_TYPES])


def document_details(documents: DataFrame, pages: DataFrame, elements: DataFrame, slug: str) -> DataFrame:
    found = documents.where(F.col("slug") == slug)
    of = found.select(F.col("id").alias("document_id"))  # so only its own pages and elements are counted
    one = page_counts(found, pages.join(of, "document_id", "left_semi"))
    return one.join(type_counts(elements.join(of, "document_id", "left_semi")).withColumnRenamed("document_id", "id"), "id", "left").na.fill(0, [f"{t}s" for t in ELEMENT_TYPES])


def verified_counts(documents: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Documents with the numbers of their pages and elements."""
    counted = elements.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("element_count"))
    return page_counts(documents, pages).join(counted, "id", "left").na.fill(0, ["element_count"])


def find_documents(documents: DataFrame, pages: DataFrame, query: str, limit: int = 10, escape: bool = False) -> DataFrame:
    """Documents whose title, slug or source file holds the query in any case. ``%`` and ``_`` are wildcards unless escaped."""
    if escape:
        query = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    like = F.lit(False)
    for c in ("title", "slug", "source_file"):
        like = like | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    found = documents.where(like).orderBy(F.asc_nulls_last("title"), "slug").limit(limit)
    mine = pages.join(found.select(F.col("id").alias("document_id")), "document_id", "left_semi")  # pages of others aren't counted
    return page_counts(found, mine).orderBy(F.asc_nulls_last("title"), "slug")


def _with_page(elements: DataFrame, pages: DataFrame) -> DataFrame:
    return elements.drop("embedding").join(pages.select(F.col("id").alias("page_id"), "page_number"), "page_id")


def list_elements(elements: DataFrame, pages: DataFrame, document_id: int | None = None, element_type: str | None = None, page_number: int | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of elements by page number and label."""
    if element_type is not None and element_type not in ELEMENT_TYPES:
        raise ValueError(f"element type must be one of {', '.join(sorted(ELEMENT_TYPES))}")
    if page_number is not None and page_number < 1:
        raise ValueError("page number must be 1 or more")
    page, page_size = max(1, page), min(max(1, page_size), 100)
    rows = elements
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    if element_type:
        rows = rows.where(F.col("element_type") == element_type)
    rows = _with_page(rows, pages)
    if page_number is not None:
        rows = rows.where(F.col("page_number") == page_number)
    return rows.orderBy("page_number", F.asc_nulls_last("label"), "id").offset((page - 1) * page_size).limit(page_size)


def element_by_label(elements: DataFrame, pages: DataFrame, document_id: int, label: str, page_number: int | None = None) -> DataFrame:
    """The element with a label; of several the one on the lowest page."""
    rows = _with_page(elements.where((F.col("document_id") == document_id) & (F.col("label") == label)), pages)
    if page_number:
        rows = rows.where(F.col("page_number") == page_number)
    return rows.orderBy("page_number", "id").limit(1)


def page_elements(elements: DataFrame, page_id: int) -> DataFrame:
    return elements.where(F.col("page_id") == page_id).drop("embedding").orderBy("element_type", F.asc_nulls_last("label"), "id")


def page_lookup(pages: DataFrame, document_id: int, page_number: int) -> DataFrame:
    """The page itself is looked up, so gaps in a document do no harm; of rows that repeat it the one with the lowest id."""
    return pages.where((F.col("document_id") == document_id) & (F.col("page_number") == page_number)).orderBy("id").limit(1)


def page_metadata(pages: DataFrame, elements: DataFrame, document_id: int, page_number: int) -> DataFrame:
    """The page with its elements (type, label, description, text cut at 500 characters) and their number."""
    one = page_lookup(pages, document_id, page_number)
    text = F.when(F.length("search_text") > 500, F.concat(F.left("search_text", F.lit(500)), F.lit("..."))).otherwise(F.nullif(F.col("search_text"), F.lit("")))
    item = F.struct(F.coalesce("element_type", F.lit("unknown")).alias("type"), "label", F.nullif(F.col("description"), F.lit("")).alias("description"), text.alias("text"), "id")
    mine = elements.join(F.broadcast(one.select(F.col("id").alias("page_id"))), "page_id", "left_semi")  # one row
    listed = mine.groupBy(F.col("page_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("elements"))
    return one.join(listed, "id", "left").withColumn("element_count", F.coalesce(F.size("elements"), F.lit(0)))


def best_image(rows: DataFrame, any_type: bool = False) -> Column:
    """Rendered image of an equation (or, with ``any_type``, of anything that has one), else the crop."""
    rendered = F.nullif(F.col("rendered_path"), F.lit(""))
    chosen = F.coalesce(rendered, F.col("crop_path"))
    return chosen if any_type else F.when(F.col("element_type") == "equation", chosen).otherwise(F.col("crop_path"))
