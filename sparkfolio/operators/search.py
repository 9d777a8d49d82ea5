"""Vector, lexical and hybrid search.

A score is a distance: lower is better. Lexical ranks are turned into distances, so that all branches of
a hybrid search share one scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexical, text, vectors
from . import batch_search

#: Results farther than this are left out.
MAX_DISTANCE = 0.94
RESULT = ["id", "score", "content", "source_type", "document_slug", "document_title", "page_number", "element_type", "element_label", "crop_path", "rendered_path", "chunk_index"]
#: What branches carry; documents and pages are looked up for the rows that are left.
KEPT = ["id", "score", "content", "source_type", "document_id", "page_id", "element_type", "element_label", "crop_path", "rendered_path", "chunk_index"]
#: Query vectors of a batched search that go to all executors; beyond, searches run in blocks of so many.
QUERY_BLOCK = 1000
#: Results that may be broadcast to find their documents and pages.
FEW = 20_000


@dataclass
class Corpus:
    """documents(id, slug, title), pages(id, document_id, page_number), chunks and elements (id, document_id, page_id, …, embedding, tsv).

    Every chunk and element has its document and page.
    """

    documents: DataFrame
    pages: DataFrame
    chunks: DataFrame
    elements: DataFrame

    def _of_document(self, rows: DataFrame, document_slug: str | None) -> DataFrame:
        if not document_slug:
            return rows
        return rows.join(self.documents.where(F.col("slug") == document_slug).select(F.col("id").alias("document_id")), "document_id", "left_semi")

    def chunk_rows(self, document_slug: str | None = None) -> DataFrame:
        """Chunks by the columns of a result, without those of document and page."""
        rows = self._of_document(self.chunks, document_slug)
        none = {c: F.lit(None).cast("string") for c in ("element_type", "element_label", "crop_path", "rendered_path")}
        return rows.withColumns({"source_type": F.lit("chunk"), **none})

    def element_rows(self, document_slug: str | None = None, element_type: str | None = None) -> DataFrame:
        """Elements by the columns of a result, without those of document and page."""
        rows = self.elements
        if element_type:
            rows = rows.where(F.col("element_type") == element_type)
        rows = self._of_document(rows, document_slug)
        content = F.coalesce(F.nullif(F.col("search_text"), F.lit("")), F.col("description"))
        return rows.withColumns({"content": content, "source_type": F.lit("element"), "element_label": F.col("label"), "chunk_index": F.lit(None).cast("int")})

    def placed(self, rows: DataFrame, few: bool = True) -> DataFrame:
        """Rows with their documents and pages; ``few`` says that a limit bounds them, so that they may be broadcast."""
        documents = self.documents.select(F.col("id").alias("document_id"), F.col("slug").alias("document_slug"), F.col("title").alias("document_title"))
        pages = self.pages.select(F.col("id").alias("page_id"), "page_number")
        some = F.broadcast if few else lambda df: df
        return pages.join(some(documents.join(some(rows), "document_id")), "page_id")


def nearest(rows: DataFrame, vector, limit: int) -> DataFrame:
    """The rows nearest to a vector by Euclidean distance; rows without a vector, or with one of another length, are left out."""
    found = rows.where(F.col("embedding").isNotNull()).withColumn("score", vectors.l2_distances(F.col("embedding"), vector)).where(F.col("score").isNotNull())
    return found.orderBy("score", "id").limit(limit)


def most_similar(rows: DataFrame, vector, limit: int) -> DataFrame:
    """The rows with the highest cosine similarity, as ``similarity``."""
    found = rows.where(F.col("embedding").isNotNull()).withColumn("similarity", vectors.cosine_similarities(F.col("embedding"), vector)).where(F.col("similarity").isNotNull())
    return found.orderBy(F.desc("similarity"), "id").limit(limit)


def lexical_matches(rows: DataFrame, query: str, limit: int, exact: bool = False) -> DataFrame:
    """Rows that hold all of the query's lexemes, by rank, with the rank as a distance.

    ``exact`` compares plain words natively instead of stems in position vectors (column ``tsv``).
    """
    lexemes = lexical.query_lexemes(query, stemmed=not exact)
    if exact:
        found = rows.withColumn("words", lexical.exact_words(F.col("content"))).withColumn("rank", lexical.exact_rank(F.col("words"), lexemes)).drop("words")
    else:
        found = rows.withColumn("rank", lexical.rank_column(F.col("tsv"), lexemes))
    found = found.where(F.col("rank").isNotNull())
    return found.orderBy(*lexical.best_first()).limit(limit).withColumn("score", vectors.distance_of_rank(F.col("rank")))


def fuse(branches: list[DataFrame], limit: int, max_distance: float = MAX_DISTANCE, columns: list[str] = RESULT) -> DataFrame:
    """Union of ranked branches with ``columns``: the best row of each (source_type, id), cut at a distance, in order of score.

    Equal scores stay in the order in which their keys first came up: by branch, then rank within it.
    """
    numbered = None
    for i, branch in enumerate(branches):
        # A branch is limited, so one task holds it; above 0, ranks still order what is at distance 0.
        order = ([F.desc("rank")] if "rank" in branch.columns else []) + [F.asc("score"), F.asc("id")]
        at = F.row_number().over(W.orderBy(*order)) + i * 1_000_000
        one = branch.withColumn("seen", at).select(*columns, "seen")
        numbered = one if numbered is None else numbered.unionByName(one)
    row = F.struct("score", F.col("seen").alias("at"), *[c for c in columns if c != "score"])
    best = numbered.groupBy("source_type", "id").agg(F.min_by(row, F.struct("score", "seen")).alias("r"), F.min("seen").alias("first_seen"))
    out = best.select(*[F.col(f"r.{c}") for c in columns], "first_seen").where(F.col("score") <= max_distance)
    return out.orderBy("score", "first_seen").limit(limit)


def keywords(query: str) -> str:
    return " ".join(w for w in query.split() if w.lower() not in text.STOPWORDS)


def search(corpus: Corpus, query: str, embed, limit: int = 10, document_slug: str | None = None, include_chunks: bool = True, include_elements: bool = True, max_distance: float = MAX_DISTANCE, exact_words: bool = False) -> DataFrame:
    """Hybrid search: up to two queries by vector and two by words, over chunks and elements.

    The query without stop words is searched too if it differs: by vector if it has over two characters, by words
    always. A query that ``embed`` gives no vector for is left out. Each branch is limited before they are fused. Chunks are scanned once, and elements once.
    """
    asked = batch_search.Asked()
    asked.add(query, keywords(query), embed, exact_words)
    kinds = [corpus.chunk_rows(document_slug)] * include_chunks + [corpus.element_rows(document_slug)] * include_elements
    best = batch_search.answers(kinds, asked, limit, max_distance, KEPT, exact_words)
    return corpus.placed(best).select(*RESULT, "first_seen").orderBy("score", "first_seen")


def search_chunks(corpus: Corpus, query: str, embed, limit: int = 10, document_slug: str | None = None, **more) -> DataFrame:
    return search(corpus, query, embed, limit, document_slug, include_elements=False, **more)


def search_elements(corpus: Corpus, query: str, embed, limit: int = 10, document_slug: str | None = None, element_type: str | None = None) -> DataFrame:
    """By vector only and without a cut, unlike a hybrid search over elements."""
    vector = embed(query)
    rows = corpus.element_rows(document_slug, element_type)
    found = nearest(rows, vector, limit) if vector is not None else rows.withColumn("score", F.lit(None).cast("double")).limit(0)
    return corpus.placed(found.select(*KEPT)).select(*RESULT).orderBy("score", "id")


def routed_search(corpus: Corpus, query: str, embed, limit: int = 10, document_slug: str | None = None, element_type: str | None = None, include_chunks: bool = True, include_elements: bool = True) -> DataFrame:
    """Which search a request means: the first of element type, no chunks, no elements that holds decides; so neither kind means elements."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    if element_type or not include_chunks:
        return search_elements(corpus, query, embed, limit, document_slug, element_type)
    if not include_elements:
        return search_chunks(corpus, query, embed, limit, document_slug)
    return search(corpus, query, embed, limit, document_slug)


def knn_join(rows: DataFrame, queries: DataFrame, limit: int, id_col: str = "id", query_id: str = "query_id") -> DataFrame:
    """query_id, id, distance, rank: the ``limit`` nearest rows of each query, exactly.

    Queries go out in blocks of bounded size; each batch of rows meets a block in one matrix product and hands on its own best,
    so what is shuffled grows with queries and batches, not with pairs.
    """
    spark, found = rows.sparkSession, None
    wanted = queries.select(F.col(query_id).alias("query_id"), vectors.as_double(F.col("embedding")).alias("embedding")).where(F.col("embedding").isNotNull())
    base = rows.where(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), "embedding")
    block: list = []

    def against(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([q[0] for q in block]), np.array([q[1] for q in block])))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                x, ids = np.array(batch["embedding"].tolist(), np.float64), batch["id"].to_numpy()
                rough = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * q @ x.T
                for name, v, near in zip(names, q, rough):
                    some, exact = batch_search.distances(x, v, near, np.inf, limit)
                    order = np.lexsort((ids[some], exact))[:limit]
                    yield pd.DataFrame({"query_id": name, "id": ids[some[order]], "distance": exact[order]})

        return base.mapInPandas(best, "query_id long, id long, distance double")

    for row in wanted.toLocalIterator():
        block.append((row["query_id"], row["embedding"]))
        if len(block) == QUERY_BLOCK:
            found, block = (against(block) if found is None else found.unionByName(against(block))), []
    if block or found is None:
        part = against(block) if block else spark.createDataFrame([], "query_id long, id long, distance double")
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def element_by_id(corpus: Corpus, element_id: int) -> DataFrame:
    documents = corpus.documents.select(F.col("id").alias("document_id"), F.col("slug").alias("document_slug"), F.col("title").alias("document_title"))
    pages = corpus.pages.select(F.col("id").alias("page_id"), "page_number")
    return corpus.elements.where(F.col("id") == element_id).drop("embedding").join(documents, "document_id").join(pages, "page_id").limit(1)


def chunk_context(chunks: DataFrame, chunk_id: int, around: int = 2) -> DataFrame:
    """The chunk and its neighbours on its page; no rows for an unknown id."""
    mid = chunks.where(F.col("id") == chunk_id).select("page_id", F.greatest(F.lit(0), F.col("chunk_index") - around).alias("low"), (F.col("chunk_index") + around).alias("high"))
    found = chunks.join(mid, "page_id").where(F.col("chunk_index").between(F.col("low"), F.col("high")))
    return found.drop("low", "high", "embedding").orderBy("chunk_index")
