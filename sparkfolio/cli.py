"""Command line: search, list, ingest, config."""

from __future__ import annotations

import argparse
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Library
from .config import load_config
from .functions.format import document_card, result_card
from .functions.lexical import vector_column
from .operators import catalog, search
from .operators.pipeline import Store, ingest_tree
from .operators.providers import HashingEmbedder


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparkfolio")
    out.add_argument("--store", default="store", help="folder of the catalog's tables")
    commands = out.add_subparsers(dest="command", required=True)
    add = commands.add_parser("ingest")
    add.add_argument("tree")
    add.add_argument("--policy", choices=["skip", "replace", "error"], default="skip")
    add.add_argument("--dry-run", action="store_true")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--document")
    find.add_argument("--type", choices=sorted(catalog.ELEMENT_TYPES))
    find.add_argument("--verbose", action="store_true")
    commands.add_parser("list")
    commands.add_parser("config")
    return out


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "config":
        for k, v in asdict(load_config()).items():
            print(f"{k} = {v}")
        return 0
    spark = SparkSession.builder.appName("sparkfolio").getOrCreate()
    store, embedder = Store(spark, given.store), HashingEmbedder()
    if given.command == "ingest":
        for r in ingest_tree(spark, given.tree, store, embedder, given.policy, given.dry_run).orderBy("slug").collect():
            print(f"{r['slug']}: {r['pages']} pages, {r['chunks']} chunks, {r['elements']} elements")
        return 0
    tables = store.tables()
    if given.command == "list":
        for r in catalog.page_counts(tables["documents"], tables["pages"]).orderBy("title", "slug").select(document_card().alias("card")).collect():
            print(r["card"])
        return 0
    chunks = tables["chunks"].withColumn("tsv", vector_column(F.col("content")))
    elements = tables["elements"].withColumn("tsv", vector_column(F.concat_ws(" ", "label", "description", "search_text")))
    library = Library(search.Corpus(tables["documents"], tables["pages"], chunks, elements), embedder)
    for r in library.search(given.query, given.limit, document_slug=given.document, element_type=given.type).select(result_card(given.verbose).alias("card")).collect():
        print(r["card"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
