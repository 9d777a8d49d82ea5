"""The public operations, one function each, over a catalog of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .functions.vectors import score_percent
from .operators import catalog, rag, search
from .operators.providers import Embedder, Generator, with_retries
from .sources.corpus import read_image


@dataclass
class Library:
    """Search, chat and catalog over one corpus, with its model services."""

    corpus: search.Corpus
    embedder: Embedder
    generator: Generator | None = None
    tree: str | None = None  # root of the extraction tree, whose images pages and elements name

    def _embed(self, query: str):
        found = with_retries(lambda: self.embedder([query]))
        return found[0] if found else None

    def status(self) -> dict:
        """Counts, and whether the services answer."""
        return {
            "documents": self.corpus.documents.count(),
            "pages": self.corpus.pages.count(),
            "embedding": self._embed("health") is not None,
            "generation": self.generator is not None and with_retries(lambda: self.generator("health"), tries=1) is not None,
        }

    def search(self, query: str, limit: int = 10, **options) -> DataFrame:
        found = search.routed_search(self.corpus, query, self._embed, limit, **options)
        return found.withColumn("score_pct", F.bround(score_percent(F.col("score")), 1))

    def list_documents(self, page: int = 1, page_size: int = 20, sort: str = "title") -> DataFrame:
        return catalog.list_documents(self.corpus.documents, self.corpus.pages, page, page_size, sort)

    def document(self, slug: str) -> DataFrame:
        return catalog.document_details(self.corpus.documents, self.corpus.pages, self.corpus.elements, slug)

    def find_documents(self, query: str, limit: int = 10) -> DataFrame:
        return catalog.find_documents(self.corpus.documents, self.corpus.pages, query, limit)

    def elements(self, **options) -> DataFrame:
        return catalog.list_elements(self.corpus.elements, self.corpus.pages, **options)

    def element(self, element_id: int) -> DataFrame:
        return search.element_by_id(self.corpus, element_id)

    def element_by_label(self, document_id: int, label: str, page_number: int | None = None) -> DataFrame:
        return catalog.element_by_label(self.corpus.elements, self.corpus.pages, document_id, label, page_number)

    def page(self, document_id: int, page_number: int) -> DataFrame:
        return catalog.page_lookup(self.corpus.pages, document_id, page_number)

    def page_metadata(self, document_id: int, page_number: int) -> DataFrame:
        return catalog.page_metadata(self.corpus.pages, self.corpus.elements, document_id, page_number)

    def _image(self, rows: DataFrame, path) -> DataFrame:
        """The image that the one row of ``rows`` (document_id and the columns of ``path``) names."""
        if self.tree is None:
            raise RuntimeError("no extraction tree")
        spark = self.corpus.documents.sparkSession
        named = rows.withColumn("image", path).join(self.corpus.documents.select(F.col("id").alias("document_id"), "slug"), "document_id").select("slug", "image").first()
        return read_image(spark, self.tree, named["slug"] if named else "", named["image"] if named else None)

    def page_image(self, document_id: int, page_number: int) -> DataFrame:
        """path, mime, width, height, content of a page's image, or no row."""
        return self._image(catalog.page_lookup(self.corpus.pages, document_id, page_number), F.col("image_path"))

    def element_image(self, element_id: int) -> DataFrame:
        """path, mime, width, height, content of an element's rendered image, or else its crop, or no row."""
        rows = self.corpus.elements.where(F.col("id") == element_id).limit(1)
        return self._image(rows, catalog.best_image(rows, any_type=True))

    def sql(self, query: str, **args) -> DataFrame:
        """A query with named parameters over the views documents, pages, chunks and elements."""
        for name in ("documents", "pages", "chunks", "elements"):
            getattr(self.corpus, name).createOrReplaceTempView(name)
        return self.corpus.documents.sparkSession.sql(query, args=args)

    def register_functions(self) -> None:
        """Table functions ``search_chunks(vector, n, document)`` and ``search_elements(vector, n, document, type)``; null means any."""
        spark = self.corpus.documents.sparkSession
        self.sql("SELECT 1")
        likeness = "aggregate(zip_with(embedding, q, (a, b) -> CAST(a AS DOUBLE) * b), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(q, 0D, (s, x) -> s + x * x)), 0D)"
        for name, extra, columns, where in (("chunks", "", "content", ""), ("elements", ", kind STRING DEFAULT NULL", "label", " AND (kind IS NULL OR element_type = kind)")):
            spark.sql(
                f"CREATE OR REPLACE TEMPORARY FUNCTION search_{name}(q ARRAY<DOUBLE>, n INT, document INT DEFAULT NULL{extra}) RETURNS TABLE (id BIGINT, {columns} STRING, similarity DOUBLE) "
                f"RETURN SELECT id, {columns}, similarity FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM (SELECT id, {columns}, {likeness} AS similarity FROM {name} WHERE embedding IS NOT NULL AND (document IS NULL OR document_id = document){where})) WHERE place <= n"
            )

    def chunk_context(self, chunk_id: int, around: int = 2) -> DataFrame:
        return search.chunk_context(self.corpus.chunks, chunk_id, around)

    def prompt(self, question: str, limit: int = 8, document_slug: str | None = None) -> tuple[str, list[dict]]:
        """The context a model is shown and its results; other documents are searched if the one named has nothing."""
        results = search.search(self.corpus, question, self._embed, limit, document_slug)
        rows = results.collect()
        if not rows and document_slug:
            rows = search.search(self.corpus, question, self._embed, limit).collect()
        if not rows:
            return "", []
        spark = self.corpus.documents.sparkSession
        ranked = spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], results.schema.add("rank", "int"))
        return rag.context(ranked).first()["text"], [r.asDict() for r in rows]

    def ask(self, question: str, last_query: str | None = None, **options) -> dict:
        if self.generator is None:
            raise RuntimeError("no generator")
        spark = self.corpus.documents.sparkSession
        one = spark.createDataFrame([(question, last_query)], "q string, last string")
        query = one.select(text.expand_followup(F.col("q"), F.col("last")).alias("x")).first()["x"]
        context, results = self.prompt(query, **options)
        answer = with_retries(lambda: self.generator(f"Context:\n{context}\n\nQuestion: {question}"))
        clean = spark.createDataFrame([(answer,)], "a string").select(text.strip_think_tags(F.col("a")).alias("a")).first()["a"]
        return {"answer": clean, "query_used": query, "sources": results}
