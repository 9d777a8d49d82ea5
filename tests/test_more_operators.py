import json

import pytest
from pyspark.sql import functions as F

from sparkfolio import cli
from sparkfolio.chat import Chat
from sparkfolio.api import Library
from sparkfolio.functions import format as cards
from sparkfolio.functions import lexical, text, vectors
from sparkfolio.operators import enrich, index, ingest, pipeline, search
from sparkfolio.operators.pipeline import Store, ingest_tree
from sparkfolio.operators.providers import HashingEmbedder
from sparkfolio.plans import registry
from sparkfolio.sources import render as render_module


def test_postings_give_what_position_vectors_give(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("content"))
    rows = parts.withColumn("tsv", lexical.vector_column(F.col("content")))
    want = [(r["id"], round(r["rank"], 9)) for r in search.lexical_matches(rows, "red widget", 15).collect()]
    got = [(r["id"], round(r["rank"], 9)) for r in index.match_postings(index.postings(rows), lexical.query_lexemes("red widget"), 15).collect()]
    assert got == want and want
    assert index.match_postings(index.postings(rows), [], 5).count() == 0


def test_cells_find_nine_of_ten_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    cells = index.Cells.fit(rows, 16)
    indexed = cells.assign(rows)
    assert indexed.count() == rows.count()
    found = {(r["query_id"], r["id"]) for r in index.near_join(indexed, cells, queries, 10, probe=12).collect()}
    exact = {(r["query_id"], r["id"]) for r in search.knn_join(rows, queries, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


@pytest.fixture
def tree(tmp_path):
    for slug in ("alpha_v1", "beta"):
        (tmp_path / slug / "pages").mkdir(parents=True)
        (tmp_path / slug / "document.json").write_text(json.dumps({"source_file": f"{slug}.pdf", "extraction_date": "2024-05-01T10:00:00"}))
        for n in (1, 2):
            page = {"page_number": n, "text": f"Page {n} of {slug} tells of glaciers. " * 60, "elements": [{"type": "figure", "label": "F", "description": "a glacier map"}]}
            (tmp_path / slug / "pages" / f"page_{n:03d}.json").write_text(json.dumps(page))
    return str(tmp_path)


def test_ingestion_by_policy(spark, tree, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    report = ingest_tree(spark, tree, store, dry_run=True)
    assert {(r["slug"], r["pages"], r["elements"]) for r in report.collect()} == {("alpha_v1", 2, 2), ("beta", 2, 2)}
    assert store.tables()["documents"].count() == 0
    ingest_tree(spark, tree, store, HashingEmbedder())
    first = store.tables()
    assert {r["title"] for r in first["documents"].collect()} == {"Alpha", "Beta"}
    assert first["chunks"].where("embedding is not null").count() == first["chunks"].count() > 4
    for t in first.values():
        assert ingest.violations(t, "id").count() == 0
    assert first["chunks"].join(first["pages"].withColumnRenamed("id", "page_id"), ["page_id", "document_id"]).count() == first["chunks"].count()
    assert ingest_tree(spark, tree, store, policy="skip").count() == 0
    with pytest.raises(ingest.DuplicateDocument):
        ingest_tree(spark, tree, store, policy="error")
    before = first["chunks"].count()
    ingest_tree(spark, tree, store, policy="replace")
    assert store.tables()["chunks"].count() == before
    kept = store.versions.parts()
    store.delete(["nobody"])
    assert store.versions.parts() == kept
    store.delete(["beta", "unknown"])
    assert [r["slug"] for r in store.tables()["documents"].collect()] == ["alpha_v1"] and store.tables()["elements"].count() == 2


def test_a_document_more_leaves_other_parts_alone(spark, tree, tmp_path, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest_tree(spark, tree, store)
    first = store.versions.parts()
    page = tmp_path / "gamma" / "pages"
    page.mkdir(parents=True)
    (tmp_path / "gamma" / "document.json").write_text(json.dumps({"source_file": "gamma.pdf"}))
    (page / "page_001.json").write_text(json.dumps({"page_number": 1, "text": "one page", "elements": []}))
    assert [(r["slug"], r["pages"], r["elements"]) for r in ingest_tree(spark, tree, store).collect()] == [("gamma", 1, 0)]
    assert store.versions.parts()[:1] == first and len(store.versions.parts()) == 2
    store.delete(["gamma"])
    assert store.versions.parts()[:1] == first
    rows = {k: sorted(map(tuple, t.select("id").collect())) for k, t in store.tables().items()}
    store.compact()
    assert len(store.versions.parts()) == 1 and {k: sorted(map(tuple, t.select("id").collect())) for k, t in store.tables().items()} == rows
    ingest_tree(spark, tree, store, policy="replace")
    assert sorted(r["slug"] for r in store.tables()["documents"].collect()) == ["alpha_v1", "beta", "gamma"]
    for t in store.tables().values():
        assert ingest.violations(t, "id").count() == 0


def test_versions_come_back_and_unnamed_parts_go(spark, tree, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest_tree(spark, tree, store)
    slugs = lambda version=None: sorted(r["slug"] for r in store.tables(version)["documents"].collect())
    store.delete(["beta"])
    assert slugs() == ["alpha_v1"] and slugs(1) == ["alpha_v1", "beta"]
    assert store.restore(1) == 3 and slugs() == ["alpha_v1", "beta"]
    assert store.vacuum() == 1 and slugs() == ["alpha_v1", "beta"]
    with pytest.raises(ValueError):
        store.restore(2)
    big = store.versions.parts()
    store.add(store._read([]))
    store.compact(enough=1)
    assert store.versions.parts()[:1] == big and len(store.versions.parts()) == 2


def test_two_writers_keep_both_documents(spark, tree, tmp_path_factory, monkeypatch):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest_tree(spark, tree, store)
    tables, other = store.tables(), Store(spark, store.root)
    part, commit = tables["documents"].where("slug = 'beta'"), other.versions.commit
    turns = []

    def slow(change):
        def late(parts):
            if not turns:
                turns.append(1)
                store.add({**store._read([]), "documents": part.withColumn("slug", F.lit("first"))})  # another writer between reading and naming
            return change(parts)

        return commit(late)

    monkeypatch.setattr(other.versions, "commit", slow)
    other.add({**store._read([]), "documents": part.withColumn("slug", F.lit("second"))}, instead_of=spark.createDataFrame([("alpha_v1",)], "slug string"))
    assert sorted(r["slug"] for r in store.tables()["documents"].collect()) == ["beta", "first", "second"]
    assert store.versions.numbers() == [1, 2, 3]


def test_ids_go_beyond_32_bits(spark, tree, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    big = spark.createDataFrame([(2**31 + 7, "old", "old.pdf")], "id long, slug string, source_file string")
    store.add(store._read([]) | {"documents": pipeline._shaped(big, "documents"), "chunks": pipeline._shaped(spark.createDataFrame([(2**40, 2**31 + 7)], "id long, document_id long"), "chunks")})
    ingest_tree(spark, tree, store)
    assert store.tables()["documents"].agg(F.max("id")).first()[0] == 2**31 + 9
    assert store.tables()["chunks"].where("id > 1099511627776").count() > 3


def test_page_summaries_are_cut_as_if_all_were_joined(spark):
    rows = [(d, n, f"{'s' * (n % 7)}{n}" if n % 5 else "") for d, pages in ((1, 400), (2, 3), (3, 0)) for n in range(1, pages + 1)]
    pages = spark.createDataFrame(rows + [(2, 9, None)], "document_id int, page_number int, summary string")
    for most, true_numbers in ((60, False), (500, True), (100_000, False)):
        got = {r["document_id"]: r["text"] for r in ingest.summary_input(pages, "summary", most=most, true_numbers=true_numbers).collect()}
        want = {}
        for d in (1, 2):
            kept = [(n, s) for e, n, s in rows if e == d and s]
            text = "\n".join(f"Page {n if true_numbers else i}: {s}" for i, (n, s) in enumerate(kept, 1))
            want[d] = text if len(text) <= most else text[:most] + "\n..."
        assert got == want


def test_pages_of_white_space_are_not_worth_a_summary(spark):
    rows = spark.createDataFrame([("\n" * 300,), ("\t" + "x" * 100,), (None,), ("\u3000" * 200,)], "t string")
    assert [r["w"] for r in rows.select(ingest.worth_summary(F.col("t")).alias("w")).collect()] == [False, True, False, False]
    ends = spark.createDataFrame([("a", None), (None, None)], "a string, b string")
    assert [r["x"] for r in ends.select(text.license_input(F.col("a"), F.col("b")).alias("x")).collect()] == ["FIRST PAGE:\na\n\nLAST PAGE:\n", "FIRST PAGE:\n\n\nLAST PAGE:\n"]


def test_command_line(spark, tree, tmp_path_factory, capsys):
    folder = str(tmp_path_factory.mktemp("store"))
    assert cli.main(["--store", folder, "ingest", tree]) == 0
    assert cli.main(["--store", folder, "list"]) == 0
    assert cli.main(["--store", folder, "search", "glacier map", "--type", "figure", "--verbose"]) == 0
    assert cli.main(["config"]) == 0
    out = capsys.readouterr().out
    assert "## Alpha (alpha_v1)\n   Pages: 2" in out and "[FIGURE] F" in out and "chunk_size = 800" in out


def test_enrichment_asks_only_where_it_must(spark):
    pages = spark.createDataFrame([(1, 1, "x " * 80, None, None), (1, 2, "short", None, None), (1, 3, "y " * 80, "there", ["k"])], "document_id int, page_number int, full_text string, summary string, keywords array<string>")
    answer = lambda prompt: "<think>hm</think> SUMMARY: about " + prompt[-4:].strip() + " KEYWORDS: A, b"
    done = {r["page_number"]: (r["summary"], r["keywords"]) for r in enrich.summarize_pages(pages, answer).collect()}
    assert done == {1: ("about x x", ["a", "b"]), 2: (None, None), 3: ("there", ["k"])}
    documents = spark.createDataFrame([(1, "T", None, None, None), (2, "U", None, None, None)], "id int, title string, summary string, keywords array<string>, license string")
    got = {r["id"]: r["summary"] for r in enrich.summarize_documents(documents, pages, lambda p: "SUMMARY: " + p.split("\n")[-1]).collect()}
    assert got == {1: "Page 1: there", 2: None}
    assert {r["id"]: r["license"] for r in enrich.extract_licenses(documents, pages, lambda p: "CC BY" if "FIRST" in p else "none").collect()} == {1: "CC BY", 2: None}
    elements = spark.createDataFrame([("figure", "F", "d", "", "text"), ("table", "T", "d", "old", None)], "element_type string, label string, description string, search_text string, full_text string")
    assert {r["label"]: r["search_text"] for r in enrich.enrich_elements(elements, lambda p: " new ").collect()} == {"F": "new", "T": "old"}

    def fails(prompt):
        raise OSError

    assert {r["label"]: r["search_text"] for r in enrich.enrich_elements(elements, fails, pause=0).collect()} == {"F": "", "T": "old"}


def test_sql_with_parameters_and_table_functions(spark):
    embed = HashingEmbedder(4)
    documents = spark.createDataFrame([(1, "d", "D")], "id int, slug string, title string")
    pages = spark.createDataFrame([(1, 1, 1)], "id int, document_id int, page_number int")
    rows = [(i, 1, 1, t, embed([t])[0]) for i, t in enumerate(["one", "two", "three"])]
    chunks = spark.createDataFrame(rows, "id bigint, document_id int, page_id int, content string, embedding array<double>")
    elements = chunks.withColumnRenamed("content", "label").withColumn("element_type", F.lit("figure"))
    library = Library(search.Corpus(documents, pages, chunks, elements), embed)
    assert library.sql("SELECT content FROM chunks WHERE id >= :low ORDER BY id LIMIT :n", low=1, n=1).first()[0] == "two"
    library.register_functions()
    vector = ", ".join(f"{x}D" for x in embed(["two"])[0])
    assert spark.sql(f"SELECT content FROM search_chunks(array({vector}), 3) ORDER BY similarity DESC, id").count() == 3
    assert spark.sql(f"SELECT * FROM search_chunks(array({vector}), 3, 9)").count() == 0
    assert spark.sql(f"SELECT * FROM search_elements(array({vector}), 2, NULL, 'figure')").count() == 2


def test_specs():
    assert cards.pages_of_spec("ALL", 3) == [1, 2, 3] and cards.pages_of_spec("2-4", 9) == [2, 3, 4] and cards.pages_of_spec("1, 5", 9) == [1, 5]
    assert cards.indexes_of("1,2 3") == [0, 1, 2]
    with pytest.raises(ValueError):
        cards.indexes_of("one")


def test_scan_distances_are_the_native_ones(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [3.0, 4.0])], "id int, v array<double>")
    q = [1.0, 1.0]
    got = rows.select("id", vectors.l2_distances(F.col("v"), q).alias("a"), vectors.l2_distance(F.col("v"), vectors.literal(q)).alias("b"), vectors.cosine_similarities(F.col("v"), q).alias("c"), vectors.cosine_similarity(F.col("v"), vectors.literal(q)).alias("d")).collect()
    for r in got:
        assert r["a"] == (None if r["b"] is None else pytest.approx(r["b"])) and r["c"] == (None if r["id"] == 2 else pytest.approx(r["d"]))


def test_rendering_and_detection_through_providers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"two pages")
    render = lambda content, dpi, most: ((n, 1000, 1000, content, f"page {n}") for n in (1, 2))
    pages = render_module.render_files(spark, str(tmp_path / "*.pdf"), render)
    assert [(r["page_number"], r["text"]) for r in pages.orderBy("page_number").collect()] == [(1, "page 1"), (2, "page 2")]
    found = render_module.detect_elements(pages, lambda p: '{"table": [{"bbox": [0, 0, 10, 10], "label": "T"}]}' if "base64" in p else "").collect()
    assert [(r["page_number"], r["type"], r["label"]) for r in found] == [(1, "table", "T"), (2, "table", "T")]
    (tmp_path / "x.png").write_bytes(b"png")
    copy = render_module.copy_to_cache(str(tmp_path / "x.png"), str(tmp_path / "cache"), "Fig 1: é")
    assert copy.endswith("Fig_1__é.png") and open(copy, "rb").read() == b"png"


def test_chat(spark):
    embed = HashingEmbedder()
    documents = spark.createDataFrame([(1, "d", "Doc")], "id int, slug string, title string")
    pages = spark.createDataFrame([(1, 1, 3)], "id int, document_id int, page_number int")
    chunks = spark.createDataFrame([(1, 1, 1, "glacier maps", 0, embed(["glacier maps"])[0])], "id int, document_id int, page_id int, content string, chunk_index int, embedding array<double>").withColumn("tsv", lexical.vector_column(F.col("content")))
    elements = spark.createDataFrame([(7, 1, 1, "figure", "Fig", "a glacier", "", "c.png", "", embed(["a glacier"])[0])], "id int, document_id int, page_id int, element_type string, label string, description string, search_text string, crop_path string, rendered_path string, embedding array<double>").withColumn("tsv", lexical.vector_column(F.col("description")))
    prompts = []
    chat = Chat(Library(search.Corpus(documents, pages, chunks, elements), embed, lambda p: prompts.append(p) or "<think>x</think>Yes [1]"))
    assert chat.sources() == "No sources available."
    assert chat.ask("glacier maps") == "Yes [1]"
    assert [r["source_type"] for r in chat.results] == ["element", "chunk"]
    assert "[1] FIGURE: Fig (from Doc, page 3)" in prompts[0] and chat.sources().startswith("[1] FIGURE: Fig | Doc p.3 | ")
    chat.ask("and rivers")
    assert chat.last_query == "and rivers" and len(chat.window()) == 5
    assert [r["id"] for r in chat.show("1, 9")] == [7]
    chat.clear()
    assert chat.results == [] and len(chat.window()) == 1


def test_a_chunk_in_context_cuts_its_page_alone(spark, sf):
    plan = registry.QUERIES["chunk_context_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(doc_id,21)") == plan.count("MapInArrow") > 0
