"""The extraction tree: ``<root>/<slug>/document.json`` and ``<root>/<slug>/pages/page_*.json``."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.images import image_header
from ..operators.numbering import running_number
from . import schemas


def file_path() -> Column:
    """Path of a row's file; Spark's metadata have it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", file_path())


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """document.json of each slug; a root without any raises AnalysisException."""
    out = _json(spark, f"{root}/*/document.json", schemas.DOCUMENT_JSON)
    return out.withColumn("slug", F.regexp_extract("path", r"([^/]+)/document\.json$", 1)).drop("path")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Page files with ``slug`` and ``file_name``, whose order is that of the pages. A JSON null counts as a missing key."""
    out = _json(spark, f"{root}/*/pages/page_*.json", schemas.PAGE_JSON)
    return out.withColumns({"slug": F.regexp_extract("path", r"([^/]+)/pages/[^/]+$", 1), "file_name": F.regexp_extract("path", r"([^/]+)$", 1)}).drop("path")


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Pages of single-file extractions, with elements as in the present layout."""
    pages = _json(spark, path, schemas.LEGACY_JSON).select("document", "source_file", "extraction_date", "model", F.explode("pages").alias("p"))
    none = F.lit(None).cast("string")
    as_now = lambda e: F.struct(e["type"].alias("type"), e["bbox_1000"].alias("bbox"), e["bbox_pixels"].alias("bbox_pixels"), e["label"].alias("label"), e["description"].alias("description"), none.alias("latex"), none.alias("search_text"), e["crop_path"].alias("crop_path"), none.alias("rendered_path"))
    return pages.select("document", "source_file", "extraction_date", "model", "p.page_number", "p.image", "p.width", "p.height", "p.text", F.transform("p.elements", as_now).alias("elements"), F.col("p.total_page_time_seconds").alias("extraction_time_seconds"))


def existing_pages(spark: SparkSession, root: str) -> DataFrame:
    """slug and page_number of the page files that are there; names without a number are passed over."""
    files = spark.read.format("binaryFile").load(f"{root}/*/pages/page_*.json").select("path")
    number = F.expr(r"try_cast(regexp_extract(path, 'page_([^/_.]+)[^/]*\\.json$', 1) AS int)")
    return files.select(F.regexp_extract("path", r"([^/]+)/pages/[^/]+$", 1).alias("slug"), number.alias("page_number")).where("page_number is not null")


def available_documents(documents: DataFrame, pages: DataFrame, ingested: DataFrame) -> DataFrame:
    """slug, pages, elements, elements with search text, and whether it is ingested, by slug."""
    size = F.coalesce(F.size("elements"), F.lit(0))
    enriched = F.coalesce(F.size(F.filter("elements", lambda e: F.length(e["search_text"]) > 0)), F.lit(0))
    counts = pages.groupBy("slug").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.greatest(size, F.lit(0))).alias("elements"), F.sum(F.greatest(enriched, F.lit(0))).alias("enriched"))
    out = documents.select("slug").join(counts, "slug", "left").na.fill(0, ["pages", "elements", "enriched"])
    known = ingested.select("slug").distinct().withColumn("ingested", F.lit(True))
    return out.join(known, "slug", "left").na.fill(False, ["ingested"]).orderBy("slug")


def document_rows(documents: DataFrame) -> DataFrame:
    """Rows of the documents table, without ids. The title comes from the slug."""
    return documents.select(
        "slug", text.title_of_slug(F.col("slug")).alias("title"), "source_file", F.expr("try_cast(extraction_date AS timestamp_ntz)").alias("extraction_date"), "model",
        F.expr("map()").cast("map<string,string>").alias("metadata"), "summary", "keywords", "license",
    )


def page_rows(pages: DataFrame) -> DataFrame:
    return pages.select("slug", "page_number", F.col("image").alias("image_path"), F.col("annotated_image").alias("annotated_image_path"), F.coalesce("text", F.lit("")).alias("full_text"), "summary", "keywords", "width", "height")


def element_rows(pages: DataFrame) -> DataFrame:
    """Elements of all pages. LaTeX is parsed from the description of equations; missing search text is the description."""
    rows = pages.select("slug", "page_number", F.posexplode("elements").alias("element_index", "e"))
    description = F.coalesce("e.description", F.lit(""))
    kind = F.coalesce("e.type", F.lit("unknown"))
    return rows.select(
        "slug", "page_number", "element_index", kind.alias("element_type"), F.coalesce(F.left("e.label", F.lit(100)), F.lit("")).alias("label"), description.alias("description"),
        F.coalesce("e.search_text", description).alias("search_text"), F.when(kind == "equation", text.parsed_latex(description)).alias("latex"), "e.crop_path",
        F.coalesce("e.rendered_path", F.lit("")).alias("rendered_path"), "e.bbox_pixels",
    )


IMAGES = "path string, mime string, width int, height int, content binary"


def _images(files: DataFrame) -> DataFrame:
    header = image_header(F.col("content"))
    return files.withColumn("mime", text.mime_of(F.regexp_extract("path", r"([^/]+)$", 1))).where("mime is not null").select("path", "mime", header["width"].alias("width"), header["height"].alias("height"), "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, mime, width, height and base64 of image files; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return _images(files).select("path", "mime", "width", "height", F.base64("content").alias("base64"))


def read_image(spark: SparkSession, root: str, slug: str, path: str | None) -> DataFrame:
    """path, mime, width, height and content of one image of a document; no row if there is none, its suffix isn't an image's or its path leaves the folder."""
    none = spark.createDataFrame([], IMAGES)
    if not path or spark.createDataFrame([(path,)], "p string").select(text.mime_of(F.col("p"))).first()[0] is None:
        return none
    plain = re.sub(r"([\\\[\]{}*?])", r"\\\1", f"{slug}/{path}")  # names may hold what globs are made of
    try:
        return _images(spark.read.format("binaryFile").load(f"{root}/{plain}").select("path", "content"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none


# Views of the plain tables as a corpus


def view_documents(documents: DataFrame) -> DataFrame:
    """Each source is a document, numbered by name."""
    names = documents.select(F.col("source").alias("slug")).where("slug is not null").distinct()
    numbered = names.withColumn("order", F.expr("try_cast(regexp_extract(slug, '([0-9]+)$', 1) AS int)"))
    return running_number(numbered.withColumn("__all", F.lit(1)), ["__all"], ["order", "slug"], "id", start=1).select(
        "id", "slug", text.title_of_slug(F.col("slug")).alias("title"), F.concat("slug", F.lit(".pdf")).alias("source_file"), F.expr("make_date(2024, 1 + id % 12, 1 + id % 28)").alias("extraction_date")
    )


def view_pages(documents: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each row is a page of its source, numbered by id."""
    rows = documents.select(F.col("doc_id").alias("id"), F.col("source").alias("slug"), F.col("text").alias("full_text"))
    numbered = running_number(rows, ["slug"], ["id"], "page_number")
    return numbered.join(catalog.select("slug", F.col("id").alias("document_id")), "slug")


#: Fixed values of the view: a part's type as an element's.
PART_TYPES = {"STANDARD": "figure", "MEDIUM": "table", "PROMO": "equation", "LARGE": "chart", "SMALL": "diagram"}


def view_elements(parts: DataFrame, vectors: DataFrame, documents: int = 20) -> DataFrame:
    """Each part is an element on the page whose id it shares; a type without counterpart is unknown."""
    kind = F.lit("unknown")
    for k, v in PART_TYPES.items():
        kind = F.when(F.col("p_type") == k, v).otherwise(kind)
    rows = parts.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % documents + 1).cast("int").alias("document_id"), F.col("p_partkey").alias("page_id"), kind.alias("element_type"), F.col("p_name").alias("label"),
        F.concat("p_brand", F.lit(" "), "p_name").alias("description"), F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" "), F.lower("p_type"))).otherwise("").alias("search_text"),
        F.concat(F.lit("elements/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("crop_path"), F.when(F.col("p_type") == "PROMO", F.concat(F.lit("rendered/"), F.col("p_partkey").cast("string"), F.lit(".png"))).otherwise("").alias("rendered_path"),
    )
    return rows.join(vectors.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
