"""Registered queries of the engine and the DuckDB SQL each is held against.

The plain tables are read as a corpus: each ``source`` is a document, each row of ``documents`` a page of it, its
chunks come from the chunker, and each row of ``part`` is an element on the page whose id it shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import format as cards
from ..functions import lexical, parse, text, vectors
from ..functions.images import image_header
from ..operators import batch_search, catalog, chunking, enrich, index, ingest, posting_index, rag, search, vector_codes
from ..sources import corpus, tree
from ..sources.versions import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STOP = "[" + ",".join(f"'{w}'" for w in text.STOPWORDS) + "]"

#: Common table expressions that rebuild the views in DuckDB.
DOCS = """
    docs AS (
        SELECT row_number() OVER (ORDER BY regexp_extract(slug, '([0-9]+)$', 1)::INT, slug)::INT AS id, slug, upper(slug[1]) || slug[2:] AS title, slug || '.pdf' AS source_file
        FROM (SELECT DISTINCT source AS slug FROM documents WHERE source IS NOT NULL)
    ), pgs AS (
        SELECT doc_id AS id, d.id AS document_id, source AS slug, text AS full_text, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS page_number
        FROM documents JOIN docs d ON d.slug = source
    )"""
ELEMENTS = (
    DOCS
    + """, els AS (
        SELECT p_partkey AS id, (p_partkey % 20 + 1)::INT AS document_id, p_partkey AS page_id,
            CASE p_type WHEN 'STANDARD' THEN 'figure' WHEN 'MEDIUM' THEN 'table' WHEN 'PROMO' THEN 'equation' WHEN 'LARGE' THEN 'chart' WHEN 'SMALL' THEN 'diagram' ELSE 'unknown' END AS element_type,
            p_name AS label, p_brand || ' ' || p_name AS description, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || lower(p_type) ELSE '' END AS search_text,
            'elements/' || p_partkey || '.png' AS crop_path, CASE WHEN p_type = 'PROMO' THEN 'rendered/' || p_partkey || '.png' ELSE '' END AS rendered_path, embedding
        FROM part LEFT JOIN embeddings ON vec_id = p_partkey
    )"""
)
VECTOR0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
PCT = "greatest(0::DOUBLE, least(100::DOUBLE, (1.0::DOUBLE - {0}) / 0.3::DOUBLE * 100))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The tables and views that queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return _table(self.spark, self._dir, name)

    @property
    def texts(self) -> DataFrame:
        """Documents for work on their texts: dealt over the cores where the table comes in fewer partitions, as one small file does."""
        rows, cores = self.documents, self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows

    @property
    def catalog(self) -> DataFrame:
        return corpus.view_documents(self.documents)

    @property
    def view_pages(self) -> DataFrame:
        return corpus.view_pages(self.documents, self.catalog)

    @property
    def view_elements(self) -> DataFrame:
        return corpus.view_elements(self.part, self.embeddings)

    @property
    def paged_elements(self) -> DataFrame:
        """Those elements whose page is in the table of documents."""
        return self.view_elements.join(self.documents.select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")

    @property
    def vector_rows(self) -> DataFrame:
        """Pages with their vectors, null where there is none."""
        return self.view_pages.join(self.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")

    @property
    def chunks(self) -> DataFrame:
        return self.chunks_of(self.texts)

    def chunks_of(self, texts: DataFrame) -> DataFrame:
        """Chunks of pages; a page's first chunk has the page's vector."""
        placed = texts.join(self.catalog.select(F.col("slug").alias("source"), F.col("id").alias("document_id")), "source")  # texts need no page number, so they are not moved
        out = chunking.chunk_pages(placed.select(F.col("doc_id").alias("id"), "document_id", F.col("text").alias("full_text")))
        out = out.select((F.col("id") * 100_000 + F.col("chunk_index")).alias("id"), "document_id", F.col("id").alias("page_id"), "content", "chunk_index", "start_char", "end_char")
        first = self.embeddings.select((F.col("vec_id") * 100_000).alias("id"), "embedding")
        return out.join(first, "id", "left")

    def vector(self, vec_id: int = 0) -> list[float]:
        return self.embeddings.where(F.col("vec_id") == vec_id).first()["embedding"]

    @property
    def corpus(self) -> search.Corpus:
        return search.Corpus(self.catalog, self.view_pages.select("id", "document_id", "page_number"), self.chunks, self.paged_elements)


def query(name: str, oracle: str | None = None):
    """Registers a function of Tables under a name."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return function

    return register


def six(c: Column) -> Column:
    """Rounded as SQL does it: half away from zero in doubles, and what is rounded to zero keeps its sign."""
    c = c.cast("double")
    return F.signum(c) * F.round(F.abs(c) * 1e6) / 1e6


# Vectors


@query("knn_l2", f"WITH {DOCS} SELECT p.id, slug, page_number, round(list_distance(embedding::DOUBLE[], {VECTOR0}), 6) AS score FROM pgs p JOIN embeddings ON vec_id = p.id ORDER BY list_distance(embedding::DOUBLE[], {VECTOR0}), p.id LIMIT 10")
def _(t: Tables) -> DataFrame:
    pages = t.view_pages.select("id", "slug", "page_number")
    found = search.nearest(t.embeddings.select(F.col("vec_id").alias("id"), "embedding").join(t.documents.select(F.col("doc_id").alias("id")), "id", "left_semi"), t.vector(), 10)
    return pages.join(F.broadcast(found.drop("embedding")), "id").orderBy("score", "id").select("id", "slug", "page_number", six(F.col("score")).alias("score"))


@query("knn_l2_filtered_document", f"WITH {DOCS} SELECT p.id, page_number, round(list_distance(embedding::DOUBLE[], {VECTOR0}), 6) AS score FROM pgs p JOIN embeddings ON vec_id = p.id WHERE slug = 'src3' ORDER BY list_distance(embedding::DOUBLE[], {VECTOR0}), p.id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return search.nearest(t.vector_rows.where("slug = 'src3'"), t.vector(), 5).select("id", "page_number", six(F.col("score")).alias("score"))


@query("knn_l2_filtered_type", f"WITH {ELEMENTS} SELECT id, label, round(list_distance(embedding::DOUBLE[], {VECTOR0}), 6) AS score FROM els WHERE element_type = 'table' AND embedding IS NOT NULL ORDER BY list_distance(embedding::DOUBLE[], {VECTOR0}), id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return search.nearest(t.view_elements.where("element_type = 'table'"), t.vector(), 5).select("id", "label", six(F.col("score")).alias("score"))


@query("knn_l2_threshold", f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {VECTOR0}), 6) AS score, round({PCT.format(f'list_distance(embedding::DOUBLE[], {VECTOR0})')}, 6) AS score_pct FROM embeddings WHERE list_distance(embedding::DOUBLE[], {VECTOR0}) <= 1.2")
def _(t: Tables) -> DataFrame:
    d = vectors.l2_distance(F.col("embedding"), vectors.literal(t.vector()))
    return t.embeddings.select(F.col("vec_id").alias("id"), six(d).alias("score"), six(vectors.score_percent(d)).alias("score_pct")).where(F.col("score") <= 1.2)


@query("knn_cosine", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR0}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {VECTOR0}) DESC, vec_id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return search.most_similar(t.embeddings.withColumnRenamed("vec_id", "id"), t.vector(), 10).select("id", six(F.col("similarity")).alias("similarity"))


@query("knn_join_batch", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), r AS (SELECT query_id, vec_id AS id, list_distance(embedding::DOUBLE[], e) AS d FROM q, embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM r) SELECT query_id, id, round(d, 6) AS distance, rank::INT AS rank FROM k WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.knn_join(t.embeddings.withColumnRenamed("vec_id", "id"), queries, 5).select("query_id", "id", six(F.col("distance")).alias("distance"), "rank")


@query("l2_normalize", "WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings UNION ALL SELECT -1, [0.0::DOUBLE, 0.0::DOUBLE]), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v) SELECT vec_id, list_transform(e, lambda x: round(CASE WHEN n = 0 THEN x ELSE x / n END, 6)) AS unit FROM n")
def _(t: Tables) -> DataFrame:
    scaled = t.embeddings.select("vec_id", F.transform(vectors.as_double(F.col("embedding")), lambda x: x * 3).alias("e"))
    zero = t.spark.range(1).select(F.lit(-1).cast("long").alias("vec_id"), vectors.literal([0, 0]).alias("e"))
    return scaled.unionByName(zero).select("vec_id", F.transform(vectors.l2_normalize(F.col("e")), six).alias("unit"))


@query("score_pct", f"SELECT vec_id, round({PCT.format('d')}, 6) AS pct FROM (SELECT vec_id, 0.5 + vec_id % 80 / 100.0::DOUBLE AS d FROM embeddings)")
def _(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", six(vectors.score_percent(F.lit(0.5) + F.col("vec_id") % 80 / 100.0)).alias("pct"))


# Catalog

PAGED = "WITH " + DOCS + """, c AS (SELECT document_id, count(*) AS n FROM pgs GROUP BY 1)
    SELECT d.id, slug, title, coalesce(n, 0) AS page_count FROM docs d LEFT JOIN c ON c.document_id = d.id ORDER BY {0} OFFSET {1} LIMIT {2}"""
COLUMNS = ("id", "slug", "title", "page_count")


@query("documents_page_title", PAGED.format("title NULLS LAST, slug", 5, 5))
def _(t: Tables) -> DataFrame:
    return catalog.list_documents(t.catalog, t.view_pages, 2, 5, "title").select(*COLUMNS)


@query("documents_page_date", PAGED.format("make_date(2024, 1 + d.id % 12, 1 + d.id % 28) DESC NULLS LAST, slug", 0, 7))
def _(t: Tables) -> DataFrame:
    return catalog.list_documents(t.catalog, t.view_pages, 0, 7, "date").select(*COLUMNS)


@query("documents_page_count", PAGED.format("coalesce(n, 0) DESC, slug", 6, 6))
def _(t: Tables) -> DataFrame:
    return catalog.list_documents(t.catalog, t.view_pages, 2, 6, "page_count").select(*COLUMNS)


@query("documents_total", "SELECT count(DISTINCT source) AS total, ceil(count(DISTINCT source) / 6.0)::BIGINT AS total_pages FROM documents")
def _(t: Tables) -> DataFrame:
    return catalog.page_total(t.catalog, 6)


@query("documents_left_join_counts", "SELECT c_custkey AS id, count(o_orderkey) AS page_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return catalog.page_counts(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("document_id")))


@query("document_type_counts", f"WITH {ELEMENTS} SELECT document_id, " + ", ".join(f"count(*) FILTER (WHERE element_type = '{k}') AS {k}s" for k in catalog.ELEMENT_TYPES) + " FROM els GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return catalog.type_counts(t.view_elements)


@query("document_details", f"WITH {ELEMENTS} SELECT d.id, slug, title, (SELECT count(*) FROM pgs WHERE document_id = d.id) AS page_count, " + ", ".join(f"(SELECT count(*) FROM els WHERE document_id = d.id AND element_type = '{k}') AS {k}s" for k in catalog.ELEMENT_TYPES) + " FROM docs d WHERE slug = 'src4'")
def _(t: Tables) -> DataFrame:
    return catalog.document_details(t.catalog, t.view_pages, t.view_elements, "src4").drop("source_file", "extraction_date")


@query("document_verify_counts", f"WITH {ELEMENTS} SELECT d.slug, (SELECT count(DISTINCT p.id) FROM pgs p WHERE p.document_id = d.id) AS page_count, (SELECT count(DISTINCT e.id) FROM els e WHERE e.document_id = d.id) AS element_count FROM docs d")
def _(t: Tables) -> DataFrame:
    return catalog.verified_counts(t.catalog, t.view_pages, t.view_elements).select("slug", "page_count", "element_count")


FIND = "WITH " + DOCS + " SELECT d.id, slug, title, (SELECT count(*) FROM pgs WHERE document_id = d.id) AS page_count FROM docs d WHERE title ILIKE '%{0}%' OR slug ILIKE '%{0}%' OR source_file ILIKE '%{0}%' ORDER BY title, slug LIMIT 10"


@query("documents_find_ilike", FIND.format("RC1"))
def _(t: Tables) -> DataFrame:
    return catalog.find_documents(t.catalog, t.view_pages, "RC1").select(*COLUMNS)


@query("documents_find_wildcard", FIND.format("c_5"))
def _(t: Tables) -> DataFrame:
    return catalog.find_documents(t.catalog, t.view_pages, "c_5").select(*COLUMNS)


@query("document_by_slug", f"WITH {DOCS} SELECT id, slug, title, source_file FROM docs WHERE slug = 'src7'")
def _(t: Tables) -> DataFrame:
    return t.catalog.where("slug = 'src7'").limit(1).drop("extraction_date")


@query("page_lookup", f"WITH {DOCS} SELECT id, document_id, page_number, full_text FROM pgs WHERE document_id = 3 AND page_number = 4")
def _(t: Tables) -> DataFrame:
    return catalog.page_lookup(t.view_pages, 3, 4).select("id", "document_id", "page_number", "full_text")


@query("page_elements", f"WITH {ELEMENTS} SELECT id, element_type, label, description FROM els WHERE page_id = 17")
def _(t: Tables) -> DataFrame:
    return catalog.page_elements(t.view_elements, 17).select("id", "element_type", "label", "description")


LISTED = "WITH " + ELEMENTS + " SELECT e.id, element_type, label, page_number, left(description, 200) AS description FROM els e JOIN pgs p ON p.id = page_id WHERE {0} ORDER BY page_number, label NULLS LAST, e.id {1}"
LIST = ("id", "element_type", "label", "page_number")


@query("elements_list_paged", LISTED.format("e.document_id = 5 AND element_type = 'figure'", "OFFSET 3 LIMIT 3"))
def _(t: Tables) -> DataFrame:
    rows = catalog.list_elements(t.view_elements, t.view_pages, 5, "figure", page=2, page_size=3)
    return rows.select(*LIST, F.left("description", F.lit(200)).alias("description"))


@query("elements_total", f"WITH {ELEMENTS} SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM els WHERE element_type = 'chart'")
def _(t: Tables) -> DataFrame:
    return catalog.page_total(t.view_elements.where("element_type = 'chart'"), 20)


@query("element_by_label", LISTED.format("e.document_id = 2 AND label = (SELECT label FROM els WHERE id = 21)", "LIMIT 1"))
def _(t: Tables) -> DataFrame:
    label = t.part.where("p_partkey = 21").first()["p_name"]
    return catalog.element_by_label(t.view_elements, t.view_pages, 2, label).select(*LIST, F.left("description", F.lit(200)).alias("description"))


@query("element_by_id", f"WITH {ELEMENTS} SELECT e.id, label, d.slug AS document_slug, d.title AS document_title, page_number FROM els e JOIN docs d ON d.id = e.document_id JOIN pgs p ON p.id = page_id WHERE e.id = 33")
def _(t: Tables) -> DataFrame:
    return search.element_by_id(t.corpus, 33).select("id", "label", "document_slug", "document_title", "page_number")


@query("element_best_image", f"WITH {ELEMENTS} SELECT id, CASE WHEN element_type = 'equation' THEN coalesce(nullif(rendered_path, ''), crop_path) ELSE crop_path END AS image, coalesce(nullif(rendered_path, ''), crop_path) AS any_image FROM els")
def _(t: Tables) -> DataFrame:
    e = t.view_elements
    return e.select("id", catalog.best_image(e).alias("image"), catalog.best_image(e, True).alias("any_image"))


# Text functions, on texts with added edges so that every branch is taken

EDGED = r"chr(9) || '  ' || replace(text, ' a', chr(13) || chr(10) || chr(9) || '  a') || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || chr(10) || ' end  ' || chr(13)"


def edged() -> Column:
    odd = F.replace(F.col("text"), F.lit(" a"), F.lit("\r\n\t  a"))
    return F.concat(F.lit("\t  "), odd, F.lit("\n \n\n\n\n end  \r"))


LINES = r"array_to_string(list_transform(string_split({0}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10))"
CLEAN = r"regexp_replace(" + LINES.format(r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')") + r", '^\s+|\s+$', '', 'g')"


@query("clean_text", f"SELECT doc_id, md5({CLEAN.format(EDGED)}) AS cleaned FROM documents")
def _(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", F.md5(text.clean_text(edged())).alias("cleaned"))


@query("normalize_ws", "SELECT doc_id, md5(regexp_replace(" + LINES.format(rf"regexp_replace(regexp_replace({EDGED}, ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')") + r", '^\s+|\s+$', '', 'g')) AS cleaned FROM documents")
def _(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", F.md5(text.normalize_whitespace(edged())).alias("cleaned"))


NUMBERED = r"array_to_string(list_transform(string_split(replace(text, ' ', chr(10)), chr(10)), lambda w, i: CASE WHEN doc_id % 2 = 0 OR i % 2 = 0 THEN lpad((i % 1000)::VARCHAR, 3, '0') || ' ' ELSE '' END || w), chr(10))"


@query("strip_line_numbers", rf"WITH n AS (SELECT doc_id, {NUMBERED} AS s FROM documents) SELECT doc_id, md5(CASE WHEN len(list_filter(list_slice(string_split(s, chr(10)), 1, 20), lambda l: regexp_matches(l, '^\s*\d{{3}}\s+'))) > 10 THEN array_to_string(list_transform(string_split(s, chr(10)), lambda l: regexp_replace(l, '^\s*\d{{3}}\s+', '')), chr(10)) ELSE s END) AS stripped FROM n")
def _(t: Tables) -> DataFrame:
    lines = F.split(F.replace(F.col("text"), F.lit(" "), F.lit("\n")), "\n", -1)
    number = lambda i: F.concat(F.lpad(((i + 1) % 1000).cast("string"), 3, "0"), F.lit(" "))
    made = F.array_join(F.transform(lines, lambda w, i: F.concat(F.when((F.col("doc_id") % 2 == 0) | ((i + 1) % 2 == 0), number(i)).otherwise(""), w)), "\n")
    return t.texts.select("doc_id", F.md5(text.strip_line_numbers(made)).alias("stripped"))


def _truncated(most: int) -> str:
    head = f"left(text, {most - 3})"
    space = f"(length({head}) - instr(reverse({head}), ' '))"
    return f"CASE WHEN length(text) <= {most} THEN text ELSE CASE WHEN instr({head}, ' ') > 0 AND {space} > {most // 2} THEN left({head}, {space}) ELSE {head} END || '...' END"


@query("truncate_text", f"SELECT doc_id, {_truncated(500)} AS t500, {_truncated(30)} AS t30 FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate(F.col("text"), 500).alias("t500"), text.truncate(F.col("text"), 30).alias("t30"))


@query("preview_text", "SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS preview FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.preview(F.col("text"), 150).alias("preview"))


@query("strip_think", r"SELECT doc_id, md5(regexp_replace(regexp_replace('<think>' || text || '</think>' || chr(10) || text || '<think>x</think> ', '(?s)<think>.*?</think>\s*', '', 'g'), '^\s+|\s+$', '', 'g')) AS answer FROM documents")
def _(t: Tables) -> DataFrame:
    made = F.concat(F.lit("<think>"), "text", F.lit("</think>\n"), "text", F.lit("<think>x</think> "))
    return t.texts.select("doc_id", F.md5(text.strip_think_tags(made)).alias("answer"))


LATEX = "text || CASE doc_id % 4 WHEN 0 THEN ' LaTeX: ' WHEN 1 THEN ' latex:' WHEN 2 THEN ' LaTeX: $' ELSE ' ' END || text || CASE doc_id % 4 WHEN 2 THEN '$' ELSE '' END"


def _latex() -> Column:
    kind = F.col("doc_id") % 4
    mark = F.when(kind == 0, " LaTeX: ").when(kind == 1, " latex:").when(kind == 2, " LaTeX: $").otherwise(" ")
    return F.concat("text", mark, "text", F.when(kind == 2, "$").otherwise(""))


@query("latex_extract", rf"WITH l AS (SELECT doc_id, {LATEX} AS s FROM documents) SELECT doc_id, CASE WHEN regexp_matches(s, '(?is)LaTeX:\s*.+') THEN regexp_split_to_array(regexp_replace(regexp_extract(s, '(?is)LaTeX:\s*(.+)', 1), '^\s+|\s+$', '', 'g'), '\.\s+[A-Z]')[1] END AS latex FROM l")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.latex_of_description(_latex()).alias("latex"))


@query("latex_parse", rf"WITH l AS (SELECT doc_id, {LATEX} AS s FROM documents), x AS (SELECT doc_id, CASE WHEN regexp_matches(s, '(?s)LaTeX:\s*.+') THEN regexp_replace(regexp_extract(s, '(?s)LaTeX:\s*(.+)', 1), '^\s+|\s+$', '', 'g') END AS s FROM l) SELECT doc_id, regexp_replace(regexp_replace(s, '(?s)^\$(.+)\$$', '\1'), '^\s+|\s+$', '', 'g') AS latex FROM x")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.parsed_latex(_latex()).alias("latex"))


ANSWER = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'summary: ' || text || chr(10) END || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'KEYWORDS: ' || replace(text, ' ', ', ') || ', ,' END"


def _answer() -> Column:
    first = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("summary: "), "text", F.lit("\n")))
    return F.concat(first, F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("KEYWORDS: "), F.replace(F.col("text"), F.lit(" "), F.lit(", ")), F.lit(", ,"))))


@query("summary_keywords", rf"WITH a AS (SELECT doc_id, {ANSWER} AS s FROM documents) SELECT doc_id, CASE WHEN regexp_matches(s, '(?is)SUMMARY:\s*.+') THEN regexp_replace(regexp_extract(split_part(s, 'KEYWORDS:', 1), '(?is)SUMMARY:\s*(.+)', 1), '^\s+|\s+$', '', 'g') END AS summary, list_slice(list_filter(list_transform(string_split(regexp_extract(s, '(?is)KEYWORDS:\s*(.+)', 1), ','), lambda w: lower(regexp_replace(w, '^\s+|\s+$', '', 'g'))), lambda w: w <> ''), 1, 8) AS keywords FROM a")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.summary_of(_answer()).alias("summary"), text.keywords_of(_answer(), 8).alias("keywords"))


@query("license_norm", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS license FROM documents")
def _(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 3
    made = F.when(kind == 0, "<think>a</think> none ").when(kind == 1, "  ").otherwise(F.col("text"))
    return t.documents.select("doc_id", F.md5(text.license_of(made)).alias("license"))


@query("license_input", f"WITH {DOCS}, e AS (SELECT document_id, min_by(full_text, page_number) AS a, max_by(full_text, page_number) AS b FROM pgs GROUP BY 1) SELECT document_id, md5('FIRST PAGE:' || chr(10) || left(a, 2000) || chr(10) || chr(10) || 'LAST PAGE:' || chr(10) || left(b, 2000)) AS input FROM e")
def _(t: Tables) -> DataFrame:
    ends = ingest.first_last_text(t.view_pages, "full_text")
    return ends.select("document_id", F.md5(text.license_input(F.col("first_text"), F.col("last_text"))).alias("input"))


@query("slug_title", "WITH s AS (SELECT DISTINCT p_partkey, replace(p_name, ' ', '_') || '-' || lower(p_type) || '_4th' || CASE p_partkey % 3 WHEN 0 THEN '_v2' WHEN 1 THEN '-2401v3' ELSE '' END AS slug FROM part) SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(translate(regexp_replace(slug, '[-_]?(v\\d+|\\d{4}v\\d+)$', ''), '_-', '  ')), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') AS title FROM s")
def _(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 3
    slug = F.concat(F.translate("p_name", " ", "_"), F.lit("-"), F.lower("p_type"), F.lit("_4th"), F.when(kind == 0, "_v2").when(kind == 1, "-2401v3").otherwise(""))
    return t.part.select("p_partkey", text.title_of_slug(slug).alias("title"))


@query("token_estimate", "SELECT doc_id, (length(text) // 4)::INT AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("image_suffix_mime", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' END AS mime FROM documents")
def _(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 6
    name = F.when(kind == 0, "a/b.PNG").when(kind == 1, "x.jpeg").when(kind == 2, "d/e.webp").when(kind == 3, "a/../b.png").when(kind == 4, "/etc/x.png").otherwise("notes.txt")
    return t.documents.select("doc_id", text.mime_of(name).alias("mime"))


@query("element_colors", "SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN [255, 107, 107] WHEN 'MEDIUM' THEN [78, 205, 196] WHEN 'PROMO' THEN [69, 183, 209] WHEN 'LARGE' THEN [150, 206, 180] WHEN 'SMALL' THEN [255, 234, 167] ELSE [221, 160, 221] END AS rgb FROM part")
def _(t: Tables) -> DataFrame:
    return t.view_elements.select(F.col("id").alias("p_partkey"), text.rgb_of_hex(text.color_of(F.col("element_type"))).alias("rgb"))


@query("element_filename", "SELECT p_partkey, 'p' || lpad(p_size::VARCHAR, 2, '0') || '_' || lower(p_type) || '_' || (p_partkey % 7) || '_' || left(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')!', '[^\\w\\s-]', '', 'g'), '\\s+', '_', 'g'), 30) || '.png' AS name, regexp_replace(p_name || ' (' || p_brand || ')!', '[^\\w\\-]', '_', 'g') AS cached FROM part")
def _(t: Tables) -> DataFrame:
    label = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")!"))
    return t.part.select("p_partkey", text.element_file_name(F.col("p_size"), F.lower("p_type"), F.col("p_partkey") % 7, label).alias("name"), text.cache_label(label).alias("cached"))


# Vision answers and boxes


@query("vision_json_elements", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'equation' END AS type, [(p_size / 1000.0::DOUBLE * 1200)::INT - CASE WHEN (p_size / 1000.0::DOUBLE * 1200)::INT > p_size / 1000.0::DOUBLE * 1200 THEN 1 ELSE 0 END, 106, 600, floor(p_size * 10 / 1000.0::DOUBLE * 1600)::INT + 16] AS bbox_pixels, p_name AS label, 'see LaTeX: x_' || p_size || ' \\alpha' AS description, CASE WHEN p_partkey % 3 = 2 THEN 'x_' || p_size || ' \\alpha' END AS latex FROM part WHERE p_partkey % 4 <> 3")
def _(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 3
    key = F.when(kind == 0, "figures").when(kind == 1, "table").otherwise("equations")
    box = F.when(F.col("p_partkey") % 2 == 0, "bbox").otherwise("bbox_2d")
    good = F.concat(F.lit('{"'), key, F.lit('": [{"'), box, F.lit('": ['), "p_size", F.lit(", 56.25, 500, "), F.col("p_size") * 10, F.lit('], "label": "'), "p_name", F.lit('", "description": "see LaTeX: x_'), "p_size", F.lit(' \\alpha"}, {"bbox": [1, 2]}], "note": "none"}'))
    fence = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```\nDone."))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("```\n"), good, F.lit("\n```"))).when(F.col("p_partkey") % 4 == 3, F.left(good, F.lit(40))).otherwise(good)
    pages = t.part.select("p_partkey", fence.alias("answer"), F.lit(1200).alias("width"), F.lit(1600).alias("height"))
    return parse.elements_of_answers(pages).select("p_partkey", "type", "bbox_pixels", "label", "description", "latex")


@query("bbox_crop_box", "SELECT p_partkey, CASE WHEN p_size * 3 > 40 THEN [greatest(0, 40 - 7), greatest(0, p_size - 7), least(100, p_size * 3 + 7), least(140, p_size + 50 + 7)] END AS crop, CASE WHEN p_size * 30 > 400 THEN [greatest(0, 40 - 7), greatest(0, p_size * 140 // 1000 - 7), least(100, p_size * 30 * 100 // 1000 + 7), least(140, 900 * 140 // 1000 + 7)] END AS scaled FROM part")
def _(t: Tables) -> DataFrame:
    w, h = F.lit(100), F.lit(140)
    pad = parse.crop_padding(w, h)
    size = F.col("p_size").cast("double")
    pixel = F.array(F.lit(40.0), size, size * 3, size + 50)
    scaled = F.array(F.lit(400.0), size, size * 30, F.lit(900.0))
    return t.part.select("p_partkey", parse.crop_box(pixel, w, h, pad, 100).alias("crop"), parse.crop_box(scaled, w, h, pad, 1000).alias("scaled"))


# Chunks

#: A text in which paragraphs, clauses and words all end chunks.
RAGGED = "CASE doc_id % 3 WHEN 0 THEN replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) WHEN 1 THEN replace(replace(text, '. ', ', '), '.' || chr(10), '; ') ELSE replace(replace(text, '.', ''), ',', '') END"


def ragged() -> Column:
    kind, c = F.col("doc_id") % 3, F.col("text")
    less = lambda x, *marks: less(F.replace(x, F.lit(marks[0][0]), F.lit(marks[0][1])), *marks[1:]) if marks else x
    return F.when(kind == 0, less(c, (".\n", ".\n\n"))).when(kind == 1, less(c, (". ", ", "), (".\n", "; "))).otherwise(less(c, (".", ""), (",", "")))


def chunk_sql(source: str, where: str = "") -> str:
    """Recursive SQL that gives ch(doc_id, chunk_index, start_char, end_char, content) of texts ``source`` in documents."""
    window = "substr(t, greatest(s, s + 800 - 160) + 1, s + 800 - greatest(s, s + 800 - 160))"
    low = "greatest(s, s + 800 - 160)"

    def last(mark: str, n: int) -> str:
        return f"CASE WHEN instr({window}, {mark}) = 0 THEN -1 ELSE length({window}) - (instr(reverse({window}), reverse({mark})) - 1) - {n} END"

    sentence = "greatest(" + ", ".join(last(m, 2) for m in ("'. '", "'.' || chr(10)", "'! '", "'!' || chr(10)", "'? '", "'?' || chr(10)")) + ")"
    para, word = last("chr(10) || chr(10)", 2), last("' '", 1)
    comma, semi, colon = last("', '", 2), last("'; '", 2), last("': '", 2)
    end = f"CASE WHEN s + 800 >= length(t) THEN length(t) WHEN {para} >= 0 THEN {low} + {para} + 2 WHEN {sentence} >= 0 THEN {low} + {sentence} + 2 WHEN {comma} >= 0 THEN {low} + {comma} + 2 WHEN {semi} >= 0 THEN {low} + {semi} + 2 WHEN {colon} >= 0 THEN {low} + {colon} + 2 WHEN {word} >= 0 THEN {low} + {word} + 1 ELSE s + 800 END"
    return rf"""cleaned AS (SELECT doc_id, {CLEAN.format('(' + source + ')')} AS t FROM documents {where}),
        walk AS (
            SELECT doc_id, t, 0 AS s, CASE WHEN length(t) <= 800 THEN length(t) ELSE ({end.replace('greatest(s, s + 800 - 160)', '640').replace('s + 800', '800')}) END AS e FROM cleaned WHERE length(t) > 0
            UNION ALL
            SELECT doc_id, t, s, {end} AS e FROM (SELECT doc_id, t, e - 200 AS s FROM walk WHERE e < length(t))
        ),
        ch AS (
            SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char, content
            FROM (SELECT *, regexp_replace(substr(t, s + 1, e - s), '^\s+|\s+$', '', 'g') AS content FROM walk) WHERE content <> ''
        )"""


@query("chunk_documents", f"WITH RECURSIVE {chunk_sql(RAGGED)} SELECT doc_id, chunk_index, start_char, end_char, md5(content) AS content FROM ch")
def _(t: Tables) -> DataFrame:
    return chunking.chunk_pages(t.texts.select("doc_id", ragged().alias("full_text"))).withColumn("content", F.md5("content"))


@query("chunk_stats", f"WITH RECURSIVE {chunk_sql('text')} SELECT source, count(*) AS chunks, sum(length(content))::BIGINT AS chars, max(length(content))::INT AS longest FROM ch JOIN documents USING (doc_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    chunks = chunking.chunk_pages(t.texts.select("source", F.col("text").alias("full_text")))
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).cast("long").alias("chars"), F.max(F.length("content")).alias("longest"))


@query("chunk_global_index", f"WITH RECURSIVE {chunk_sql('text')} SELECT source, doc_id, chunk_index, (row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_index) - 1)::INT AS global_index FROM ch JOIN documents USING (doc_id)")
def _(t: Tables) -> DataFrame:
    chunks = chunking.chunk_pages(t.texts.select("source", "doc_id", F.col("text").alias("full_text"))).drop("content", "start_char", "end_char")
    return chunking.with_global_index(chunks, "source", "doc_id")


@query("chunk_context_range", f"WITH RECURSIVE {chunk_sql('text')} SELECT doc_id * 100000 + chunk_index AS id, chunk_index, md5(content) AS content FROM ch WHERE doc_id = 21 AND chunk_index BETWEEN 0 AND 3 AND EXISTS (SELECT 1 FROM ch WHERE doc_id = 21 AND chunk_index = 1)")
def _(t: Tables) -> DataFrame:
    page = t.documents.where(F.col("doc_id") == 2_100_001 // 100_000)  # a chunk's id names its page; no other is cut
    return search.chunk_context(t.chunks_of(page), 2_100_001, 2).select("id", "chunk_index", F.md5("content").alias("content"))


# Questions and conversations


@query("keywords_extract", rf"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '' AND NOT list_contains({STOP}, lower(w))), ' ') AS keywords FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.keywords_of_query(F.col("text")).alias("keywords"))


ASKED = "CASE (conv_id + turn) % 7 WHEN 0 THEN 'Show me a figure of ' WHEN 1 THEN 'And what about ' WHEN 2 THEN 'Are there charts related to this? ' WHEN 3 THEN 'no, ' WHEN 4 THEN 'tables ' WHEN 5 THEN 'anything about it ' ELSE '' END || text"


def _asked() -> Column:
    kind, out = (F.col("conv_id") + F.col("turn")) % 7, F.lit("")
    for i, s in enumerate(("Show me a figure of ", "And what about ", "Are there charts related to this? ", "no, ", "tables ", "anything about it ")):
        out = F.when(kind == i, s).otherwise(out)
    return F.concat(out, "text")


def _any_sql(patterns, start: str = "") -> str:
    return "'" + start + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")'"


@query("intent_elements", f"SELECT conv_id, turn, regexp_matches(lower({ASKED}), {_any_sql(text.ELEMENT_PATTERNS)}) AS elements FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.asks_for_elements(_asked()).alias("elements"))


@query(
    "followup_expand",
    rf"""WITH a AS (SELECT conv_id, turn, {ASKED} AS text FROM conversations WHERE role = 'user'),
    q AS (SELECT *, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS q, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM a),
    c AS (SELECT *, regexp_replace(regexp_replace(q, '{text.FOLLOWUP_PREFIX}', ''), '^\s+|\s+$', '', 'g') AS short,
        regexp_replace(regexp_replace(regexp_replace(q, '{text.REFERENCE}', '', 'g'), '[?\s]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM q)
    SELECT conv_id, turn, CASE WHEN coalesce(last, '') = '' THEN text
        WHEN regexp_matches(q, {_any_sql(text.FOLLOWUP_STARTS, '^')}) THEN CASE WHEN short <> '' THEN short || ' ' || last ELSE text END
        WHEN regexp_matches(q, {_any_sql(text.REFERENCES)}) THEN plain || ' ' || last ELSE text END AS query FROM c""",
)
def _(t: Tables) -> DataFrame:
    return rag.followups(t.conversations.withColumn("text", _asked())).select("conv_id", "turn", "query")


@query("message_window", "SELECT conv_id, turn, count(*) OVER w AS messages, md5(string_agg(role || ':' || text, chr(10)) OVER w) AS content FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def _(t: Tables) -> DataFrame:
    seen = rag.message_window(t.conversations, 4)
    joined = F.array_join(F.transform("window", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return seen.select("conv_id", "turn", F.size("window").cast("long").alias("messages"), F.md5(joined).alias("content"))


@query("search_terms", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE regexp_replace(regexp_replace(text, '[\"''\\n]', '', 'g'), '^\\s+|\\s+$', '', 'g') END AS terms FROM conversations")
def _(t: Tables) -> DataFrame:
    kind = F.col("turn") % 3
    answer = F.when(kind == 0, "Error querying").when(kind == 1, ' "" ').otherwise(F.concat(F.lit('"'), "text", F.lit('"')))
    return t.conversations.select("conv_id", "turn", text.search_terms(answer, F.col("text")).alias("terms"))


# Words, fusion, hybrid search

WORDS = r"list_filter(regexp_split_to_array(lower(full_text), '[^\p{L}\p{N}]+'), lambda w: true)"


@query("lexical_exact_topk", f"WITH {DOCS}, w AS (SELECT id, {WORDS} AS w FROM pgs), r AS (SELECT id, (len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'thing')))::DOUBLE / len(w) AS r FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'thing')) SELECT id, round(r, 6) AS rank FROM r ORDER BY r DESC, id LIMIT 10")
def _(t: Tables) -> DataFrame:
    pages = t.texts.join(t.catalog.select(F.col("slug").alias("source")), "source")
    rows = pages.select(F.col("doc_id").alias("id"), lexical.exact_words(F.col("text")).alias("words"))
    return rows.select("id", lexical.exact_rank(F.col("words"), ["the", "thing"]).alias("r")).where("r is not null").orderBy(F.desc("r"), "id").limit(10).select("id", six(F.col("r")).alias("rank"))


#: The words of parts whose stem is another word.
STEMS = {"economy": "economi", "large": "larg"}


def _vectors_sql(content: str) -> str:
    """places(id, lexeme, positions) of texts ``content`` in els, which hold plain words and numbers only and no stop words."""
    stem = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STEMS.items()) + " ELSE w END"
    words = f"SELECT id, regexp_extract_all(lower({content}), '[a-z]+|[0-9]+') AS words FROM els"
    return f"{ELEMENTS.strip()}, tok AS (SELECT id, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM ({words})), places AS (SELECT id, {stem} AS lexeme, list(place::INT ORDER BY place) AS positions FROM tok GROUP BY 1, 2)"


def _pair_rank_sql(a: str, b: str) -> str:
    """ranks(id, rank) of rows that hold two lexemes: each pair of places counts by its distance."""
    near = "CASE WHEN abs(x - y) > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(x - y) / 1.5::DOUBLE - 2)) END"
    pairs = f"SELECT p.id, x, y FROM places p JOIN places q ON p.id = q.id, unnest(p.positions) AS u(x), unnest(q.positions) AS v(y) WHERE p.lexeme = '{a}' AND q.lexeme = '{b}'"
    return f"ranks AS (SELECT id, round(1 - product(1 - sqrt(0.01::DOUBLE * ({near}))), 9) AS rank FROM ({pairs}) GROUP BY 1)"


WORDED = "concat_ws(' ', label, description, search_text)"


@query("tsvector_build", f"WITH {_vectors_sql(WORDED)} SELECT id, string_agg(chr(39) || lexeme || chr(39) || ':' || array_to_string(positions, ','), ' ' ORDER BY lexeme) AS tsv FROM places GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.view_elements.select("id", lexical.shown(lexical.vector_column(F.concat_ws(" ", "label", "description", "search_text"))).alias("tsv"))


@query("lexical_rank", f"WITH {_vectors_sql(WORDED)}, {_pair_rank_sql('red', 'widget')} SELECT id, label, round(rank, 6) AS rank, round(greatest(0, 1 - 2 * rank), 6) AS score FROM ranks JOIN els USING (id) ORDER BY ranks.rank DESC, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    rows = t.view_elements.withColumn("tsv", lexical.vector_column(F.concat_ws(" ", "label", "description", "search_text")))
    return search.lexical_matches(rows, "red widgets", 20).select("id", "label", six(F.col("rank")).alias("rank"), six(F.col("score")).alias("score"))


@query("summary_tsvector")
def _(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", lexical.vector_column(F.col("text")).alias("summary_tsv"))


BRANCHES = """
    b1 AS (SELECT vec_id AS id, 'chunk' AS source_type, list_distance(embedding::DOUBLE[], {v0}) AS score FROM embeddings ORDER BY score, id LIMIT 20),
    b2 AS (SELECT vec_id AS id, 'chunk' AS source_type, list_distance(embedding::DOUBLE[], {v1}) AS score FROM embeddings ORDER BY score, id LIMIT 20),
    s AS (SELECT *, row_number() OVER (ORDER BY score, id) AS seen FROM b1 UNION ALL SELECT *, 1000000 + row_number() OVER (ORDER BY score, id) FROM b2),
    f AS (SELECT id, min(score) AS score, min(seen) AS seen FROM s GROUP BY 1)""".replace("{v0}", VECTOR0).replace("{v1}", VECTOR0.replace("= 0", "= 1"))


@query("fuse_min_score", f"WITH {BRANCHES} SELECT id, round(score, 6) AS score FROM f WHERE score <= 1.3 ORDER BY score, seen LIMIT 15")
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumnRenamed("vec_id", "id").withColumn("source_type", F.lit("chunk"))
    missing = {c: F.lit(None).cast("string") for c in search.RESULT if c not in ("id", "score", "source_type")}
    branches = [search.nearest(rows, t.vector(i), 20).withColumns(missing) for i in (0, 1)]
    return search.fuse(branches, 15, 1.3).select("id", six(F.col("score")).alias("score"))


def _embed(t: Tables):
    """Vectors of queries: the stored vector that a query's length names."""
    return lambda q: t.vector(len(q) % 100)


HYBRID = "what the thing is"
SHORT = search.keywords(HYBRID)


def _hybrid_sql(chunks: bool, elements: bool, limit: int) -> str:
    """The branches of a hybrid search over chunks and elements, by exact words, fused."""
    rows = []
    if chunks:
        rows.append("chunk_rows")
    if elements:
        rows.append("element_rows")
    parts, n = [], 0
    for wording in (HYBRID, SHORT):
        v = f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {len(wording) % 100})"
        for r in rows:
            parts.append(f"SELECT *, {n} * 1000000 + row_number() OVER (ORDER BY score, id) AS seen FROM (SELECT id, source_type, list_distance(embedding::DOUBLE[], {v}) AS score FROM {r} WHERE embedding IS NOT NULL ORDER BY score, id LIMIT {limit})")
            n += 1
    for wording in (HYBRID, SHORT):
        lexemes = lexical.query_lexemes(wording, stemmed=False)
        count = " + ".join(f"len(list_filter(w, lambda x: x = '{x}'))" for x in lexemes)
        holds = " AND ".join(f"list_contains(w, '{x}')" for x in lexemes)
        for r in rows:
            parts.append(f"SELECT id, source_type, greatest(0, 1 - 2 * rank) AS score, {n} * 1000000 + row_number() OVER (ORDER BY rank DESC, id) AS seen FROM (SELECT id, source_type, ({count})::DOUBLE / len(w) AS rank FROM (SELECT id, source_type, regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+') AS w FROM {r}) WHERE {holds} ORDER BY rank DESC, id LIMIT {limit})")
            n += 1
    chunk_rows = "chunk_rows AS (SELECT doc_id * 100000 + chunk_index AS id, 'chunk' AS source_type, content, CASE WHEN chunk_index = 0 THEN embedding END AS embedding FROM ch LEFT JOIN embeddings ON vec_id = doc_id)"
    element_rows = "element_rows AS (SELECT e.id, 'element' AS source_type, coalesce(nullif(search_text, ''), description) AS content, embedding FROM els e JOIN pgs p ON p.id = e.page_id JOIN docs d ON d.id = e.document_id)"
    return f"WITH RECURSIVE {chunk_sql('text')}, {ELEMENTS.strip()}, {chunk_rows}, {element_rows}, s AS ({' UNION ALL '.join(parts)}), f AS (SELECT source_type, id, min(score) AS score, min(seen) AS seen FROM s GROUP BY 1, 2) SELECT source_type, id, round(score, 6) AS score FROM f WHERE score <= 1.2 ORDER BY f.score, seen LIMIT {limit}"


def _hybrid(t: Tables, chunks: bool, elements: bool, limit: int) -> DataFrame:
    out = search.search(t.corpus, HYBRID, _embed(t), limit, include_chunks=chunks, include_elements=elements, max_distance=1.2, exact_words=True)
    return out.select("source_type", "id", six(F.col("score")).alias("score"))


@query("hybrid_search", _hybrid_sql(True, True, 10))
def _(t: Tables) -> DataFrame:
    return _hybrid(t, True, True, 10)


@query("search_chunks", _hybrid_sql(True, False, 8))
def _(t: Tables) -> DataFrame:
    return _hybrid(t, True, False, 8)


def _inflected(words: list[str]) -> dict[str, str]:
    """The stems of words, and of what stems alike: by endings that the stemmer takes away."""
    ends = ["", "s", "es", "ed", "ing", "ings", "ingly", "edly", "ly", "lies", "li", "'", "'s", "e", "y", "ies", "ied", "ional", "ate", "ation"]
    bases = {b for w in words for x in (w, lexical.stem(w)) for b in (x, x + x[-1], x[:-1])}
    forms = {b + e for b in bases for e in ends if b + e not in lexical.STOP}
    wanted = {lexical.stem(w) for w in words}
    return {f: lexical.stem(f) for f in sorted(forms) if lexical.stem(f) in wanted}


#: Words of the queries below, all other words that stem alike, and their stems.
QUERY_WORDS = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget standard medium promo economy thing".split()
STEM_TABLE = ", ".join(f"('{w.replace(chr(39), chr(39) * 2)}', '{x}')" for w, x in _inflected(QUERY_WORDS).items())
#: Plurals and two lexemes, one lexeme, three lexemes.
ASKED = "SELECT p_partkey AS query_id, CASE p_partkey % 150 WHEN 0 THEN p_name || 's' WHEN 50 THEN 'what are the things in ' || p_size ELSE p_name || ' ' || lower(p_type) END AS query FROM part WHERE p_partkey % 50 = 0"


def _lexemes_sql(name: str, rows: str, content: str, keys: str) -> str:
    """``name``(keys, lexeme, place) of the tokens of ``content``, those of a hyphenated word after it, that are in the table of stems or are numbers."""
    token = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*(?:''[\p{L}\p{N}]+)?"
    parts = f"flatten(list_transform(regexp_extract_all(lower({content}), '{token}'), lambda x: CASE WHEN contains(x, '-') THEN list_prepend(x, string_split(x, '-')) ELSE [x] END))"
    return f"{name}_tokens AS (SELECT {keys}, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM (SELECT {keys}, {parts} AS w FROM {rows})), {name} AS (SELECT {keys}, coalesce(lexeme, t.w) AS lexeme, place FROM {name}_tokens t LEFT JOIN stems s ON s.w = t.w WHERE lexeme IS NOT NULL OR regexp_full_match(t.w, '[0-9]+'))"


def _hybrid_rows_sql() -> str:
    chunk_rows = "SELECT 0 AS kind, doc_id * 100000 + chunk_index AS id, content AS worded, CASE WHEN chunk_index = 0 THEN embedding END AS embedding FROM ch LEFT JOIN embeddings ON vec_id = doc_id"
    element_rows = "SELECT 1, e.id, concat_ws(' ', label, description, search_text), embedding FROM els e JOIN pgs p ON p.id = e.page_id JOIN docs d ON d.id = e.document_id"
    return f"WITH RECURSIVE {chunk_sql('text')}, {ELEMENTS.strip()}, stems(w, lexeme) AS (VALUES {STEM_TABLE}), found AS ({chunk_rows} UNION ALL {element_rows})"


def _hybrid_stems_sql(asked: str, limit: int, max_distance: float) -> str:
    """Hybrid search of many queries by stems: all pairs of queries and rows, ranked and fused."""
    short = f"array_to_string(list_filter(string_split(query, ' '), lambda x: NOT list_contains({STOP}, lower(x))), ' ')"
    near = "CASE WHEN abs(a.place - b.place) > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a.place - b.place) / 1.5::DOUBLE - 2)) END"
    return f"""{_hybrid_rows_sql()}, asked AS ({asked}),
        wording AS (SELECT query_id, 0 AS n, query AS w FROM asked UNION ALL SELECT query_id, 1, {short} FROM asked WHERE {short} <> query),
        near AS (SELECT query_id, n, kind, f.id, list_distance(f.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM wording JOIN embeddings v ON v.vec_id = length(w) % 100, found f WHERE f.embedding IS NOT NULL AND (n = 0 OR length(w) > 2)),
        {_lexemes_sql("meant", "wording", "w", "query_id, n")}, lexemes AS (SELECT DISTINCT query_id, n, lexeme FROM meant), {_lexemes_sql("said", "found", "worded", "kind, id")},
        hits AS (SELECT query_id, n, kind, id, s.lexeme, place FROM said s JOIN lexemes l ON l.lexeme = s.lexeme),
        full_hits AS (SELECT query_id, n, kind, id, lexeme, place FROM hits JOIN (SELECT h.query_id, h.n, kind, id FROM hits h JOIN (SELECT query_id, n, count(*) AS lexemes FROM lexemes GROUP BY 1, 2) c ON h.query_id = c.query_id AND h.n = c.n GROUP BY h.query_id, h.n, kind, id, c.lexemes HAVING count(DISTINCT lexeme) = c.lexemes) USING (query_id, n, kind, id)),
        ranks AS (
            SELECT query_id, n, kind, id, 1 - product(1 - sqrt(0.01::DOUBLE * ({near}))) AS rank FROM full_hits a JOIN full_hits b USING (query_id, n, kind, id) WHERE a.lexeme < b.lexeme GROUP BY ALL
            UNION ALL
            SELECT query_id, n, kind, id, 0.1::DOUBLE * list_sum(list_transform(range(1, count(*) + 1), lambda j: 1 / (j * j)::DOUBLE)) / 1.64493406685::DOUBLE FROM full_hits GROUP BY ALL HAVING count(DISTINCT lexeme) = 1
        ),
        branches AS (
            SELECT query_id, kind, id, score, (2 * n + kind) * 1000000 + row_number() OVER (PARTITION BY query_id, n, kind ORDER BY score, id) AS seen FROM near QUALIFY row_number() OVER (PARTITION BY query_id, n, kind ORDER BY score, id) <= {limit}
            UNION ALL
            SELECT query_id, kind, id, greatest(0, 1 - 2 * rank), (4 + 2 * n + kind) * 1000000 + row_number() OVER (PARTITION BY query_id, n, kind ORDER BY round(rank, 9) DESC, id) FROM ranks QUALIFY row_number() OVER (PARTITION BY query_id, n, kind ORDER BY round(rank, 9) DESC, id) <= {limit}
        ),
        fused AS (SELECT query_id, kind, id, min(score) AS score, min(seen) AS seen FROM branches GROUP BY ALL)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), seen))::INT AS rank, CASE kind WHEN 0 THEN 'chunk' ELSE 'element' END AS source_type, id, round(score, 6) AS score
        FROM fused WHERE score <= {max_distance} QUALIFY rank <= {limit}"""


def _embed_all(t: Tables):
    stored = {r["vec_id"]: r["embedding"] for r in t.embeddings.where("vec_id < 100").collect()}
    return lambda wordings: [stored[len(w) % 100] for w in wordings]


def _worded(t: Tables) -> search.Corpus:
    """The corpus with texts that searches turn into position vectors."""
    c = t.corpus
    return search.Corpus(c.documents, c.pages, c.chunks.withColumn("tsv", F.col("content")), c.elements.withColumn("tsv", F.concat_ws(" ", "label", "description", "search_text")))


@query("hybrid_batch", _hybrid_stems_sql(ASKED, 10, search.MAX_DISTANCE))
def _(t: Tables) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_partkey") % 150
    text_of = F.when(kind == 0, F.concat(name, F.lit("s"))).when(kind == 50, F.concat(F.lit("what are the things in "), F.col("p_size").cast("string"))).otherwise(F.concat(name, F.lit(" "), F.lower("p_type")))
    asked = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), text_of.alias("query"))
    return batch_search.search_batch(_worded(t), asked, _embed_all(t)).select("query_id", "rank", "source_type", "id", six(F.col("score")).alias("score"))


@query("hybrid_default", "SELECT source_type, id, score FROM (" + _hybrid_stems_sql(f"SELECT 0 AS query_id, '{HYBRID}' AS query", 10, search.MAX_DISTANCE) + ")")
def _(t: Tables) -> DataFrame:
    return search.search(_worded(t), HYBRID, _embed(t)).select("source_type", "id", six(F.col("score")).alias("score"))


@query("search_elements", f"WITH {ELEMENTS} SELECT e.id, e.label AS element_label, coalesce(nullif(search_text, ''), description) AS content, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {len(HYBRID)})), 6) AS score FROM els e JOIN pgs p ON p.id = page_id JOIN docs d ON d.id = e.document_id WHERE embedding IS NOT NULL AND d.slug = 'src2' ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {len(HYBRID)})), e.id LIMIT 6")
def _(t: Tables) -> DataFrame:
    return search.search_elements(t.corpus, HYBRID, _embed(t), 6, "src2").select("id", "element_label", "content", six(F.col("score")).alias("score"))


# Contexts and sources

SCORED = ELEMENTS + """, r AS (SELECT row_number() OVER (PARTITION BY e.document_id ORDER BY 0.7 + e.id % 30 / 100.0::DOUBLE, e.id) AS rank, e.*, d.title AS document_title, p.page_number, 0.7 + e.id % 30 / 100.0::DOUBLE AS score
    FROM els e JOIN docs d ON d.id = e.document_id JOIN pgs p ON p.id = e.page_id)"""
RANKED = SCORED[:-1] + " QUALIFY rank <= 6)"


def _scored(t: Tables) -> DataFrame:
    """Every element with a score and its rank among those of its document."""
    rows = t.corpus.placed(t.corpus.element_rows(), few=False).withColumn("source_type", F.when(F.col("id") % 3 == 0, "chunk").otherwise("element")).withColumn("content", F.col("description"))
    rows = rows.withColumn("score", F.lit(0.7) + F.col("id") % 30 / 100.0)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy("score", "id")))


def _ranked(t: Tables) -> DataFrame:
    """The best six elements of each document."""
    return _scored(t).where("rank <= 6")


@query("rag_context", f"WITH {RANKED} SELECT document_id, string_agg('[' || rank || '] ' || CASE WHEN id % 3 = 0 THEN 'TEXT' ELSE upper(element_type) || ': ' || label END || ' (from ' || document_title || ', page ' || page_number || ')' || chr(10) || '    ' || left(description, 500), chr(10) || chr(10) ORDER BY rank) AS text FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rag.context(_ranked(t), ["document_id"])


@query("sources_list", f"WITH {RANKED} SELECT document_id, string_agg('[' || rank || '] ' || CASE WHEN id % 3 = 0 THEN 'TEXT chunk' ELSE upper(element_type) || ': ' || label END || ' | ' || document_title || ' p.' || page_number || ' | ' || round_even({PCT.format('score')}, 0)::INT || '%', chr(10) ORDER BY rank) AS text FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rag.sources(_ranked(t), ["document_id"])


# Ingestion


@query("ingest_skip_existing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part) AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(t: Tables) -> DataFrame:
    there = t.part.select(F.col("p_partkey").cast("string").alias("slug"), F.lit(None).cast("string").alias("source_file"))
    there = there.unionByName(t.supplier.select(F.lit("-").alias("slug"), F.col("s_suppkey").cast("string").alias("source_file")))
    new = t.orders.select(F.col("o_orderkey").cast("string").alias("slug"), F.col("o_custkey").cast("string").alias("source_file"))
    return ingest.skip_existing(new, there).select(F.col("slug").cast("long").alias("o_orderkey"))


@query("ingest_delete_cascade", f"WITH {ELEMENTS} SELECT 'documents' AS name, count(*) AS n FROM docs WHERE slug NOT IN ('src1', 'src5') UNION ALL SELECT 'pages', count(*) FROM pgs WHERE slug NOT IN ('src1', 'src5') UNION ALL SELECT 'elements', count(*) FROM els WHERE document_id NOT IN (SELECT id FROM docs WHERE slug IN ('src1', 'src5'))")
def _(t: Tables) -> DataFrame:
    gone = t.spark.createDataFrame([("src1",), ("src5",), ("nothing",)], "slug string")
    left = ingest.delete_documents({"documents": t.catalog, "pages": t.view_pages, "elements": t.view_elements}, gone)
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("ingest_duplicate_source", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(t: Tables) -> DataFrame:
    there = t.orders.select(F.col("o_custkey").cast("string").alias("slug"), F.lit("-").alias("source_file"))
    new = t.customer.select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_name").alias("source_file"))
    return ingest.existing(new, there).select(F.col("slug").cast("long").alias("c_custkey"))


@query("ingest_dry_run_counts", f"WITH RECURSIVE {chunk_sql('text')}, {ELEMENTS.strip()} SELECT d.id AS document_id, (SELECT count(*) FROM pgs WHERE document_id = d.id) AS pages, (SELECT count(*) FROM ch JOIN documents USING (doc_id) WHERE source = d.slug) AS chunks, (SELECT count(*) FROM els WHERE document_id = d.id) AS elements FROM docs d")
def _(t: Tables) -> DataFrame:
    return ingest.dry_run(t.view_pages.select("document_id", "full_text"), t.view_elements)


@query("ingest_element_rows", "SELECT p_partkey AS id, left(repeat(p_name, 20), 100) AS label, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS search_text, CASE WHEN p_partkey % 3 = 0 THEN [1.0::DOUBLE] END AS embedding FROM part")
def _(t: Tables) -> DataFrame:
    even = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))
    vector = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    made = t.part.select(F.col("p_partkey").alias("id"), F.repeat("p_name", F.lit(20)).alias("label"), even.alias("search_text"), F.lit(None).cast("string").alias("latex"), F.lit(None).cast("string").alias("rendered_path"), vector.alias("embedding"))
    return ingest.normalized_elements(made).select("id", "label", "search_text", "embedding")


@query("assigned_ids", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) + 500)::INT AS id FROM part")
def _(t: Tables) -> DataFrame:
    return ingest.with_ids(t.part.select("p_partkey"), "p_partkey", 500).withColumn("id", F.col("id").cast("int"))


@query("uniqueness_violations", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return ingest.violations(t.orders, "o_custkey", "o_orderpriority")


@query("doc_summary_input", f"WITH {DOCS}, s AS (SELECT document_id, page_number, full_text AS s FROM pgs), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS i FROM s WHERE s <> ''), j AS (SELECT document_id, string_agg('Page ' || i || ': ' || s, chr(10) ORDER BY i) AS text FROM n GROUP BY 1) SELECT document_id, md5(CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '...' ELSE text END) AS text FROM j")
def _(t: Tables) -> DataFrame:
    return ingest.summary_input(t.view_pages, "full_text", most=2000).withColumn("text", F.md5("text"))


@query("first_last_page_text", f"WITH {DOCS} SELECT document_id, min_by(full_text, page_number) AS first_text, max_by(full_text, page_number) AS last_text FROM pgs GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return ingest.first_last_text(t.view_pages, "full_text")


@query("extraction_progress", f"WITH {DOCS}, done AS (SELECT document_id, count(*) AS n FROM pgs WHERE document_id % 4 > 0 AND (document_id % 2 = 0 OR page_number > 1) GROUP BY 1), total AS (SELECT document_id, count(*) AS n FROM pgs GROUP BY 1) SELECT document_id, total.n AS total, coalesce(done.n, 0) AS extracted, coalesce(done.n, 0) >= total.n AS complete FROM total LEFT JOIN done USING (document_id)")
def _(t: Tables) -> DataFrame:
    pages = t.view_pages.select("document_id", "page_number")
    return ingest.progress(pages.where("document_id % 4 > 0 and (document_id % 2 = 0 or page_number > 1)"), pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("total")))


@query("pages_missing", f"WITH {DOCS} SELECT document_id, page_number FROM pgs WHERE page_number % 5 = 0")
def _(t: Tables) -> DataFrame:
    pages = t.view_pages.select("document_id", "page_number")
    return pages.join(pages.where("page_number % 5 <> 0"), ["document_id", "page_number"], "left_anti")


@query("worth_summary", r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 400 AS worth FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ingest.worth_summary(F.concat(F.lit("\n\t"), "text", F.repeat(F.lit("\n"), F.lit(400))), 400).alias("worth"))


# Cards, drawing plans, metadata, statistics, side tables


@query("result_cards", f"WITH {SCORED} SELECT id, CASE WHEN id % 3 = 0 THEN '[TEXT] Chunk ' || (id % 10) ELSE '[' || upper(element_type) || '] ' || label END || chr(10) || '  Score: ' || printf('%.1f', round_even({PCT.format('score')}, 1)) || '% | Page ' || page_number || ' | ' || document_title || chr(10) || '  ' || left(description, 200) || '...' AS card FROM r")
def _(t: Tables) -> DataFrame:
    return _scored(t).withColumn("chunk_index", F.col("id") % 10).select("id", cards.result_card(True).alias("card"))


@query("tool_cards", f"WITH {SCORED} SELECT r.id, '[' || rank || '] ' || CASE WHEN r.id % 3 = 0 THEN 'TEXT CHUNK' ELSE upper(element_type) || ': ' || label END || chr(10) || '  Document: ' || d.slug || chr(10) || '  Page: ' || page_number || chr(10) || '  Score: ' || printf('%.1f', round_even({PCT.format('score')}, 1)) || '%' || chr(10) || '  Content: ' || left(description, 300) || '...' AS card FROM r JOIN docs d ON d.id = r.document_id")
def _(t: Tables) -> DataFrame:
    return _scored(t).select("id", cards.tool_card(F.col("rank")).alias("card"))


@query("document_cards", f"WITH {DOCS} SELECT d.id, '## ' || title || ' (' || slug || ')' || chr(10) || '   Pages: ' || (SELECT count(*) FROM pgs WHERE document_id = d.id) || CASE WHEN d.id % 2 = 0 THEN chr(10) || '   Summary: ' || repeat('ab ', 66) || 'ab...' ELSE '' END AS card FROM docs d")
def _(t: Tables) -> DataFrame:
    documents = t.catalog.withColumn("summary", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("ab "), F.lit(90))))
    return catalog.page_counts(documents, t.view_pages).select("id", cards.document_card().alias("card"))


@query("drawn_boxes", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [p_size, 2, 30, 40] WHEN 1 THEN [p_size * 600 // 1000, 0, 300, 800] WHEN 2 THEN [p_size, 5, 1001, 9] END AS box FROM part")
def _(t: Tables) -> DataFrame:
    kind, size = F.col("p_partkey") % 3, F.col("p_size")
    pixels = F.when(kind == 0, F.array(size, F.lit(2), F.lit(30), F.lit(40)))
    box = F.when(kind == 1, F.array(size.cast("double"), F.lit(0.0), F.lit(500.0), F.lit(1000.0))).otherwise(F.array(size.cast("double"), F.lit(5.0), F.lit(1001.0), F.lit(9.0)))
    return t.part.select("p_partkey", cards.drawn_box(pixels, box, F.lit(600), F.lit(800), F.lit("table"))["box"].alias("box"))


@query("latex_sources", r"WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x_' || p_size WHEN 1 THEN 'a &= ' || p_size WHEN 2 THEN '\begin{cases} ' || p_size || ' \end{cases}' ELSE '' END AS b FROM part) SELECT p_partkey, CASE WHEN b <> '' THEN '\documentclass[preview,border=2pt]{standalone}' || chr(10) || '\usepackage{amsmath}' || chr(10) || '\usepackage{amssymb}' || chr(10) || '\begin{document}' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '$\displaystyle ' || b || '$' WHEN 1 THEN '\begin{align*}' || chr(10) || b || chr(10) || '\end{align*}' ELSE b END || chr(10) || '\end{document}' || chr(10) END AS source FROM l".replace("\\\\", "\\"))
def _(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    formula = F.when(kind == 0, F.concat(F.lit("$x_"), size, F.lit("$"))).when(kind == 1, F.concat(F.lit("\\(a &= "), size, F.lit("\\)"))).when(kind == 2, F.concat(F.lit("\\begin{cases} "), size, F.lit(" \\end{cases}"))).otherwise("")
    return t.part.select("p_partkey", cards.latex_source(formula).alias("source"))


@query("page_metadata", f"WITH {ELEMENTS} SELECT p.id, page_number, full_text, (SELECT count(*) FROM els WHERE page_id = p.id)::INT AS element_count, (SELECT min(label) FROM els WHERE page_id = p.id) AS label FROM pgs p WHERE document_id = 6 AND page_number = 2")
def _(t: Tables) -> DataFrame:
    return catalog.page_metadata(t.view_pages, t.view_elements, 6, 2).select("id", "page_number", "full_text", "element_count", F.col("elements")[0]["label"].alias("label"))


@query("enrichment_stats", f"WITH {ELEMENTS} SELECT d.id AS document_id, (SELECT count(*) FROM pgs WHERE document_id = d.id) AS pages, (SELECT count(*) FROM pgs WHERE document_id = d.id AND page_number % 2 = 0) AS pages_summarized, (SELECT count(*) FROM pgs WHERE document_id = d.id AND length(regexp_replace(full_text, '^\\s+|\\s+$', '', 'g')) < 100) AS pages_short, (SELECT count(*) FROM els WHERE document_id = d.id) AS elements, (SELECT count(*) FROM els WHERE document_id = d.id AND search_text <> '') AS elements_enriched FROM docs d")
def _(t: Tables) -> DataFrame:
    pages = t.view_pages.withColumn("summary", F.when(F.col("page_number") % 2 == 0, "s"))
    return enrich.enrichment_stats(pages, t.view_elements)


@query("extraction_stats", f"WITH {DOCS} SELECT document_id, count(*) AS pages, round_even(avg(length(full_text) / 100.0::DOUBLE), 2) AS avg_seconds FROM pgs GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return enrich.extraction_stats(t.view_pages.withColumn("extraction_time_seconds", F.length("full_text") / 100.0))


@query("rendered_sizes", "SELECT p_partkey, [floor(p_size * 100 * least(1.0::DOUBLE, 2048.0::DOUBLE / (p_size * 100)))::INT, floor(p_size * 50 * least(1.0::DOUBLE, 2048.0::DOUBLE / (p_size * 100)))::INT] AS size FROM part")
def _(t: Tables) -> DataFrame:
    size = parse.rendered_size(F.col("p_size") * 100, F.col("p_size") * 50)
    return t.part.select("p_partkey", F.array(size["width"], size["height"]).alias("size"))


@query("postings_build", f"WITH {_vectors_sql('description')} SELECT lexeme, id, positions FROM places")
def _(t: Tables) -> DataFrame:
    return index.postings(t.view_elements.select("id", lexical.vector_column(F.col("description")).alias("tsv"))).select("lexeme", "id", "positions")


@query("postings_match", f"WITH {_vectors_sql('description')}, {_pair_rank_sql('red', 'widget')} SELECT id, round(rank, 6) AS rank FROM ranks ORDER BY ranks.rank DESC, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    table = index.postings(t.view_elements.select("id", lexical.vector_column(F.col("description")).alias("tsv")))
    return index.match_postings(table, lexical.query_lexemes("red widgets"), 20).select("id", six(F.col("rank")).alias("rank"))


#: Queries of one, two and three lexemes.
LOOKED_UP = ("widgets", "red widgets", "brand red widget")


def _topk_sql(content: str, limit: int) -> str:
    """The best rows of each of ``LOOKED_UP`` by ranking every row that has all lexemes."""
    asked = ", ".join(f"({len(q.split())}, '{x}')" for q in LOOKED_UP for x in lexical.query_lexemes(q))
    near = "CASE WHEN abs(a.place - b.place) > 100 THEN 1e-30::DOUBLE ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(a.place - b.place) / 1.5::DOUBLE - 2)) END"
    hits = "hits AS (SELECT n, id, p.lexeme, unnest(positions) AS place FROM places p JOIN asked a ON a.lexeme = p.lexeme WHERE (SELECT count(*) FROM places o JOIN asked b ON b.lexeme = o.lexeme WHERE o.id = p.id AND b.n = a.n) = a.n)"
    pairs = f"SELECT n, id, 1 - product(1 - sqrt(0.01::DOUBLE * ({near}))) AS rank FROM hits a JOIN hits b USING (n, id) WHERE a.lexeme < b.lexeme GROUP BY ALL"
    single = "SELECT n, id, 0.1::DOUBLE * list_sum(list_transform(range(1, count(*) + 1), lambda j: 1 / (j * j)::DOUBLE)) / 1.64493406685::DOUBLE FROM hits WHERE n = 1 GROUP BY ALL"
    return f"WITH {_vectors_sql(content)}, asked(n, lexeme) AS (VALUES {asked}), {hits}, ranks AS ({pairs} UNION ALL {single}) SELECT n AS lexemes, id, round(rank, 6) AS rank FROM ranks QUALIFY row_number() OVER (PARTITION BY n ORDER BY round(rank, 9) DESC, id) <= {limit}"


@query("posting_index_topk", _topk_sql("description", 20))
def _(t: Tables) -> DataFrame:
    found = posting_index.PostingIndex(t.spark, f"{shared_dir(t.spark)}/postings-{uuid.uuid4().hex}")
    found.add(t.view_elements.select("id", lexical.vector_column(F.col("description")).alias("tsv")))
    best = [found.search(lexical.query_lexemes(q), 20).select(F.lit(len(q.split())).alias("lexemes"), "id", six(F.col("rank")).alias("rank")) for q in LOOKED_UP]
    return best[0].unionByName(best[1]).unionByName(best[2])


NEIGHBOURS = "SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id))::INT AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 5"


@query("knn_cells", NEIGHBOURS)
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumnRenamed("vec_id", "id")
    cells = index.Cells.fit(rows, 16)
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.near_join(cells.assign(rows), cells, queries, 5, probe=4, exact=True).select("query_id", "id", six(F.col("distance")).alias("distance"), "rank")


@query("knn_codes", NEIGHBOURS)
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumnRenamed("vec_id", "id")
    books = vector_codes.Codebooks.fit(rows)
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    at = f"{shared_dir(t.spark)}/codes-{uuid.uuid4().hex}"
    books.codes(rows).write.partitionBy("cell").parquet(at)
    found = vector_codes.nearest_by_codes(books, t.spark.read.schema(vector_codes.CODES).parquet(at), rows, queries, 5)
    return found.select("query_id", "id", six(F.col("distance")).alias("distance"), "rank")


@query(
    "tree_enriched",
    "SELECT source AS slug, printf('page_%09d.json', doc_id) AS file_name, doc_id::INT AS page_number, text, CASE WHEN length(text) > 300 THEN 'Text of ' || length(text) || ' characters' END AS summary, CASE WHEN length(text) > 300 THEN 2 ELSE 1 END::BIGINT AS changed_by FROM documents WHERE source IS NOT NULL",
)
def _(t: Tables) -> DataFrame:
    """An extraction tree of all texts, written, enriched where pages are long, merged, and read with the write that changed each file last."""
    root = f"{shared_dir(t.spark)}/tree-{uuid.uuid4().hex}"
    rows = t.documents.where("source IS NOT NULL").select(F.col("source").alias("slug"), F.format_string("page_%09d.json", "doc_id").alias("file_name"), F.col("doc_id").cast("int").alias("page_number"), "text")
    tree.write_tree(tree.tree_files(rows), root)
    long = F.length("text") > 300
    pages = tree.tree_pages(tree.read_tree(t.spark, root))
    tree.write_tree(tree.tree_files(pages.withColumn("summary", F.when(long, F.concat(F.lit("Text of "), F.length("text").cast("string"), F.lit(" characters"))))), root)
    last = tree.tree_changes(t.spark, root).groupBy("slug", "file_name").agg(F.max("commit").alias("changed_by"))
    return tree.tree_pages(tree.read_tree(t.spark, root)).join(last, ["slug", "file_name"]).select("slug", "file_name", "page_number", "text", "summary", "changed_by")


@query(
    "image_sizes",
    """WITH i AS (SELECT doc_id, ['png', 'gif', 'webp', 'webp', 'webp', 'jpeg', NULL][1 + doc_id % 7] AS format, (1 + coalesce(length(text), 0) % 16000)::INT AS width, (1 + doc_id % 16000)::INT AS height FROM documents)
    SELECT doc_id, format, CASE WHEN format IS NOT NULL THEN width END AS width, CASE WHEN format IS NOT NULL THEN height END AS height FROM i""",
)
def _(t: Tables) -> DataFrame:
    """Headers of all formats before whole texts, in turn with texts that are no image."""
    width, height = 1 + F.coalesce(F.length("text"), F.lit(0)) % 16000, 1 + F.col("doc_id") % 16000
    big = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    little = lambda v, n: F.concat(*[big(F.shiftright(v.cast("long"), 8 * i).bitwiseAND(255), 1) for i in range(n)])
    webp = lambda kind, *rest: F.concat(F.lit((b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0").hex()), *rest)
    headers = [
        F.concat(F.lit((b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR").hex()), big(width, 4), big(height, 4)),
        F.concat(F.lit(b"GIF89a".hex()), little(width, 2), little(height, 2)),
        webp(b"VP8 ", F.lit("5001009d012a"), little(width, 2), little(height, 2)),
        webp(b"VP8L", F.lit("2f"), little(width - 1 + (height - 1) * (1 << 14), 4)),
        webp(b"VP8X", F.lit("00000000"), little(width - 1, 3), little(height - 1, 3)),
        F.concat(F.lit("ffd8ffe000040000ffffc2000b08"), big(height, 2), big(width, 2)),
        F.lit(""),
    ]
    chosen = F.element_at(F.array(*headers), (F.col("doc_id") % len(headers) + 1).cast("int"))
    rows = t.documents.select("doc_id", F.concat(F.unhex(chosen), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    return rows.select("doc_id", image_header(F.col("content")).alias("h")).select("doc_id", "h.*")
