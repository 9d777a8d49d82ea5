"""From an extraction tree to the catalog's tables, as one batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import corpus, schemas
from ..sources.versions import Versions
from . import ingest
from .chunking import chunk_pages
from .numbering import running_number
from .providers import Embedder, embed_column

TABLES = {"documents": schemas.DOCUMENTS, "pages": schemas.PAGES, "chunks": schemas.CHUNKS, "elements": schemas.ELEMENTS}

#: Folder of tables that an ingestion works on, beside the parts.
KEPT = "reports"


class Store:
    """Versions of the four tables under one folder.

    A version is a list of parts, and a part holds the documents of one ingestion with all their pages, chunks and elements. Adding documents writes
    only their part; taking some away rewrites only the parts that hold them. Parts are written whole before a version names them, so a
    failed run leaves the last version as it was, and writers that come at the same time each get a version of their own. ``compact`` joins small parts, ``restore`` goes back
    to an older version, ``vacuum`` deletes what no recent version names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, root)

    def _read(self, parts: list[str]) -> dict[str, DataFrame]:
        if not parts:
            return {k: self.spark.createDataFrame([], s) for k, s in TABLES.items()}
        return {k: self.spark.read.schema(s).parquet(*[f"{self.root}/{part}/{k}" for part in parts]) for k, s in TABLES.items()}

    def _write_part(self, tables: dict[str, DataFrame]) -> str:
        name = uuid.uuid4().hex
        for k, t in tables.items():
            t.write.parquet(f"{self.root}/{name}/{k}")
        return name

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """Of the last version, or of an older one."""
        return self._read(self.versions.parts(version))

    def _without(self, gone: DataFrame, parts: list[str]) -> list[str]:
        """The parts once the documents of ``gone`` (slug) have left them."""
        if not parts:
            return []
        holding = self._read(parts)["documents"].select("slug", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("part"))
        touched = {r["part"] for r in holding.join(gone.select("slug").distinct(), "slug", "left_semi").select("part").distinct().collect()}
        if not touched:
            return parts
        whole = [p for p in parts if p not in touched]  # all touched parts are rewritten at once, as one
        return [*whole, self._write_part(ingest.delete_documents(self._read([p for p in parts if p in touched]), gone))]

    def add(self, tables: dict[str, DataFrame], instead_of: DataFrame | None = None) -> None:
        """A version with the rows of ``tables`` as a part of their own, and without the documents of ``instead_of`` (slug)."""
        new = self._write_part(tables)
        self.versions.commit(lambda parts: [*(parts if instead_of is None else self._without(instead_of, parts)), new])

    def delete(self, slugs: list[str]) -> None:
        gone = self.spark.createDataFrame([(s,) for s in slugs], "slug string")
        parts = self.versions.parts()
        if self.tables()["documents"].join(gone, "slug", "left_semi").limit(1).count() and parts:
            self.versions.commit(lambda parts: self._without(gone, parts))

    def compact(self, enough: int = 1 << 30) -> None:
        """Joins the parts of fewer bytes than ``enough`` into one; larger parts stay as they are."""
        small = [p for p in self.versions.parts() if self.versions.size(p) < enough]
        if len(small) > 1:
            joined = self._write_part(self._read(small))
            # If one of them was rewritten meanwhile, the join is of no use and all stays.
            self.versions.commit(lambda parts: [joined, *[p for p in parts if p not in small]] if set(small) <= set(parts) else parts)

    def restore(self, version: int) -> int:
        """A new version with the parts of an older one; the number of the new one."""
        older = self.versions.parts(version)
        missing = set(older) - set(self.versions.folders())
        if missing:
            raise ValueError(f"version {version} names parts that are deleted")
        return self.versions.commit(lambda _: older)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the parts that none of the last ``keep`` versions names, and says how many. No ingestion may be under way."""
        named = {p for n in self.versions.numbers()[-keep:] for p in self.versions.parts(n)}
        gone = [p for p in self.versions.folders() if p not in named and p != KEPT]
        for p in [*gone, KEPT]:
            self.versions.remove(p)
        return len(gone)

    def keep(self, rows: DataFrame) -> DataFrame:
        """Rows as they are now, read from a table beside the parts."""
        path = f"{self.root}/{KEPT}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def _shaped(rows: DataFrame, table: str) -> DataFrame:
    empty = rows.sparkSession.createDataFrame([], TABLES[table])
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def _numbered(rows: DataFrame, order: list[str], after: int) -> DataFrame:
    """Ids that follow on ``after``; rows are spread by hash stretches, so ids are dense but only stable for the same rows."""
    keyed = rows.withColumns({"__all": F.lit(1), "__k": F.pmod(F.xxhash64(*order), F.lit(1 << 40))})
    return running_number(keyed, ["__all"], ["__k", *order], "id", start=after + 1, width=1 << 30, kind="long").drop("__all", "__k")


def ingest_tree(spark: SparkSession, root: str, store: Store, embedder: Embedder | None = None, policy: str = "skip", dry_run: bool = False) -> DataFrame:
    """Adds the documents of a tree. Policy for those that are there: ``skip``, ``replace`` or ``error``.

    Returns what each new document adds (slug, pages, chunks, elements); with ``dry_run`` nothing is written.
    """
    if policy not in ("skip", "replace", "error"):
        raise ValueError("policy must be skip, replace or error")
    there = store.tables()
    documents = corpus.document_rows(corpus.read_documents(spark, root))
    if policy == "skip":
        documents = ingest.skip_existing(documents, there["documents"])
    elif policy == "error":
        documents = ingest.require_new(documents, there["documents"])
    source = corpus.read_pages(spark, root).join(documents.select("slug"), "slug", "left_semi")
    if not dry_run:
        documents, source = store.keep(documents), store.keep(source)  # the tree's files are read once
    pages, elements = corpus.page_rows(source), corpus.element_rows(source)
    chunks = chunk_pages(pages.select("slug", "page_number", "full_text"))
    if not dry_run:
        chunks = store.keep(chunks)  # and texts are cut once
    count = lambda t, name: t.groupBy("slug").agg(F.count(F.lit(1)).alias(name))
    report = documents.select("slug")
    for t, name in ((pages, "pages"), (chunks, "chunks"), (elements, "elements")):
        report = report.join(count(t, name), "slug", "left")
    report = report.na.fill(0)
    if dry_run:
        return report
    report = store.keep(report)  # before anything changes

    if embedder is not None:
        chunks = embed_column(chunks, "content", embedder)
        elements = embed_column(elements, "search_text", embedder)
    last = {k: t.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for k, t in there.items()}
    documents = _numbered(documents, ["slug"], last["documents"])
    of_document = documents.select("slug", F.col("id").alias("document_id"))
    pages = _numbered(pages.join(of_document, "slug"), ["slug", "page_number"], last["pages"])
    of_page = pages.select("slug", "page_number", "document_id", F.col("id").alias("page_id"))
    chunks = _numbered(chunks.join(of_page, ["slug", "page_number"]), ["slug", "page_number", "chunk_index"], last["chunks"])
    elements = _numbered(elements.join(of_page, ["slug", "page_number"]), ["slug", "page_number", "element_index"], last["elements"])
    new = {"documents": documents, "pages": pages, "chunks": chunks, "elements": elements}
    if embedder is not None:
        new["elements"] = ingest.normalized_elements(elements)
    store.add({k: _shaped(t, k) for k, t in new.items()}, report.select("slug") if policy == "replace" else None)
    return report


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as JSON lines, one folder for each slug."""
    pages.write.partitionBy("slug").mode("overwrite").json(path)
