import json

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio import config
from sparkfolio.api import Library
from sparkfolio.functions import vectors
from sparkfolio.operators import catalog, chunking, ingest, numbering, providers, rag, search
from sparkfolio.plans.registry import six
from sparkfolio.sources import corpus
from sparkfolio.streaming import incremental


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,;!\n", max_size=600), st.integers(20, 120), st.integers(0, 15))
def test_chunks_cover_the_text(text, size, overlap):
    found = chunking.chunk_text(text, size, overlap)
    whole = text.strip()
    assert [c[0] for c in found] == list(range(len(found)))
    covered = set()
    for _, start, end, content in found:
        assert 0 < end - start <= size and content == whole[start:end].strip() != ""
        covered |= set(range(start, end))
    assert all(whole[i].isspace() for i in set(range(len(whole))) - covered)


@pytest.mark.parametrize("text, end", [("aaaa\n\nbb cc dd", 6), ("aa. bb! cc dd", 8), ("aa: bb, cc dd", 8), ("aa: bb cc dd", 4), ("aaaa bbbb cc", 10), ("aaaabbbbccdd", 12)])
def test_break_points(text, end):
    assert chunking.break_point(text, 0, len(text)) == end


def test_an_overlap_that_would_never_end_is_refused():
    with pytest.raises(ValueError):
        chunking.chunk_text("x" * 1000, 100, 80)


def test_global_index_skips_empty_pages(spark):
    pages = spark.createDataFrame([(1, 1, "word " * 60), (1, 2, " "), (1, 3, None), (1, 4, "end")], "doc int, page int, full_text string")
    chunks = chunking.with_global_index(chunking.chunk_pages(pages, size=100, overlap=20), "doc", "page").orderBy("page", "chunk_index").collect()
    assert [r["global_index"] for r in chunks] == list(range(len(chunks))) and {r["page"] for r in chunks} == {1, 4}


def test_running_number_is_row_number_over_stretches(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("g"))
    got = {(r["g"], r["k"]): r["n"] for r in numbering.running_number(rows, ["g"], ["k"], "n", width=16).collect()}
    for g in "ab":
        assert [got[x] for x in sorted(k for k in got if k[0] == g)] == list(range(1, sum(k[0] == g for k in got) + 1))


@pytest.fixture(scope="module")
def library(spark):
    embed = providers.HashingEmbedder()
    documents = spark.createDataFrame([(1, "maps", "Maps"), (2, "empty", "Empty")], "id int, slug string, title string").withColumns({"source_file": F.concat("slug", F.lit(".pdf")), "extraction_date": F.lit("2024-01-01")})
    pages = spark.createDataFrame([(10, 1, 1), (11, 1, 2)], "id int, document_id int, page_number int")
    texts = ["conformal map projection", "glacier monitoring from space", "map of rivers"]
    chunks = spark.createDataFrame([(i, 1, 10, t, i, embed([t])[0]) for i, t in enumerate(texts)], "id int, document_id int, page_id int, content string, chunk_index int, embedding array<double>")
    chunks = chunks.withColumn("tsv", search.lexical.vector_column(F.col("content")))
    elements = spark.createDataFrame([(5, 1, 11, "figure", "Fig 1", "a projection", "", embed(["a projection"])[0]), (6, 1, 11, "table", "Tab 1", "numbers", "glacier table", None)], "id int, document_id int, page_id int, element_type string, label string, description string, search_text string, embedding array<double>")
    elements = elements.withColumns({"crop_path": F.lit("c.png"), "rendered_path": F.lit(""), "tsv": search.lexical.vector_column(F.concat_ws(" ", "label", "description", "search_text"))})
    return Library(search.Corpus(documents, pages, chunks, elements), embed, lambda prompt: "<think>…</think> An answer [1]")


def test_hybrid_search_finds_by_vector_and_by_stem(library):
    rows = library.search("glaciers monitored").collect()
    assert ("chunk", 1) in {(r["source_type"], r["id"]) for r in rows}
    assert all(r["score"] <= search.MAX_DISTANCE for r in rows) and [r["score"] for r in rows] == sorted(r["score"] for r in rows)


def test_routing(library):
    assert {r["source_type"] for r in library.search("projection", include_chunks=False, include_elements=False).collect()} == {"element"}
    assert {r["source_type"] for r in library.search("map projection", include_elements=False).collect()} == {"chunk"}
    assert [r["id"] for r in library.search("x", element_type="figure").collect()] == [5]
    with pytest.raises(ValueError):
        library.search("x", 51)


def test_a_failing_embedder_leaves_words(library):
    found = search.search(library.corpus, "glacier", lambda q: None)
    assert {r["id"] for r in found.collect()} == {1, 6}


def test_ask(library):
    out = library.ask("and glaciers", "ice")
    assert out["answer"] == "An answer [1]" and out["query_used"] == "glaciers ice"
    assert library.status()["documents"] == 2


def test_lookups(library):
    assert library.element(5).first()["document_slug"] == "maps"
    assert [r["id"] for r in library.chunk_context(0, 1).collect()] == [0, 1]
    assert library.chunk_context(99).count() == 0
    assert [(r["slug"], r["page_count"]) for r in library.list_documents(0, 500).collect()] == [("empty", 0), ("maps", 2)]
    assert library.document("maps").first()["figures"] == 1
    assert [r["slug"] for r in library.find_documents("MAP").collect()] == ["maps"]
    assert catalog.find_documents(library.corpus.documents, library.corpus.pages, "%", escape=True).count() == 0
    assert catalog.element_by_label(library.corpus.elements, library.corpus.pages, 1, "Fig 1").first()["page_number"] == 2
    with pytest.raises(ValueError):
        library.elements(element_type="photo")


def test_lookups_of_repeated_rows_and_by_label(spark, library):
    assert library.element_by_label(1, "Tab 1").first()["id"] == 6 and library.element_by_label(1, "Tab 1", 9).count() == 0
    pages = spark.createDataFrame([(9, 1, 1), (4, 1, 1), (7, 1, 2)], "id int, document_id int, page_number int")
    assert catalog.page_lookup(pages, 1, 1).first()["id"] == 4
    found = library.page_metadata(1, 2).first()
    assert (found["id"], found["element_count"], [e["label"] for e in found["elements"]]) == (11, 2, ["Fig 1", "Tab 1"])
    assert library.page_metadata(1, 1).first()["element_count"] == 0 and library.page_metadata(1, 7).count() == 0


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0, 9.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(vectors.l2_normalize(F.col("a")).alias("n"), vectors.l2_normalize(F.col("z")).alias("z"), vectors.cosine_similarity(F.col("a"), F.col("z")).alias("c"), vectors.l2_distance(F.col("a"), F.col("z")).alias("d")).first()
    assert got["n"] == [0.6, 0.8] and got["z"] == [0.0, 0.0] and got["c"] == 0.0 and got["d"] == 5.0


def test_knn_join_with_many_blocks_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rows = spark.range(60).select("id", F.array((F.col("id") * 37 % 60).cast("double"), (F.col("id") % 7).cast("double")).alias("embedding"))
    queries = rows.where("id < 8").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.knn_join(rows, queries, 4).collect()}
    data = {r["id"]: r["embedding"] for r in rows.collect()}
    for q in range(8):
        order = sorted(data, key=lambda i: (sum((a - b) ** 2 for a, b in zip(data[i], data[q])) ** 0.5, i))
        assert [got[q, k] for k in range(1, 5)] == order[:4]


def test_ingest_policies(spark):
    there = spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf")], "slug string, source_file string")
    new = spark.createDataFrame([("a", "x.pdf"), ("c", "b.pdf"), ("d", "d.pdf")], "slug string, source_file string")
    assert [r["slug"] for r in ingest.skip_existing(new, there).collect()] == ["d"]
    with pytest.raises(ingest.DuplicateDocument):
        ingest.require_new(new, there)
    assert ingest.require_new(new.where("slug = 'd'"), there).count() == 1


def test_context_and_sources(spark):
    rows = spark.createDataFrame([(1, "element", "figure", "F", "T", 3, "c" * 600, 0.85), (2, "chunk", None, None, "U", 4, None, 0.7)], "rank int, source_type string, element_type string, element_label string, document_title string, page_number int, content string, score double")
    assert rag.context(rows).first()["text"] == f"[1] FIGURE: F (from T, page 3)\n    {'c' * 500}\n\n[2] TEXT (from U, page 4)\n    "
    assert rag.sources(rows).first()["text"] == "[1] FIGURE: F | T p.3 | 50%\n[2] TEXT chunk | U p.4 | 100%"


def test_embedding_failures_are_null(spark):
    calls = []

    def flaky(texts):
        raise OSError("down")

    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r["embedding"] for r in providers.embed_column(rows, "t", flaky, pause=0).collect()] == [None, None]
    good = providers.embed_column(rows, "t", providers.HashingEmbedder(), batch=1).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in good) and not calls


@pytest.fixture
def tree(tmp_path):
    for slug in ("first_v2", "second"):
        (tmp_path / slug / "pages").mkdir(parents=True)
        (tmp_path / slug / "document.json").write_text(json.dumps({"source_file": f"{slug}.pdf", "total_pages": 3, "extraction_date": "2024-05-01T10:00:00"}))
        for n in (1, 2):
            elements = [{"type": "equation", "bbox": [1, 2, 3, 4], "label": "E", "description": "LaTeX: $x$"}] if n == 2 else []
            (tmp_path / slug / "pages" / f"page_{n:03d}.json").write_text(json.dumps({"page_number": n, "text": f"Text of page {n}. " * 80, "elements": elements}, indent=1))
    (tmp_path / "second" / "pages" / "page_x.json").write_text("{}")
    return str(tmp_path)


def test_extraction_tree(spark, tree):
    documents, pages = corpus.read_documents(spark, tree), corpus.read_pages(spark, tree)
    known = spark.createDataFrame([("second",)], "slug string")
    got = {r["slug"]: (r["pages"], r["elements"], r["enriched"], r["ingested"]) for r in corpus.available_documents(documents, pages, known).collect()}
    assert got == {"first_v2": (2, 1, 0, False), "second": (3, 1, 0, True)}
    assert {r["title"] for r in corpus.document_rows(documents).collect()} == {"First", "Second"}
    element = corpus.element_rows(pages).first()
    assert (element["latex"], element["search_text"], element["rendered_path"]) == ("x", "LaTeX: $x$", "")
    assert corpus.existing_pages(spark, tree).count() == 4


def test_streaming_ingestion_adds_each_page_once(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    counts = []
    for checkpoint in ("a", "a", "b"):  # the last run has lost what it knew
        incremental.ingest_available(spark, tree, str(out / "chunks"), str(out / checkpoint)).awaitTermination()
        counts.append(spark.read.parquet(str(out / "chunks")).count())
    assert counts[0] > 4 and len(set(counts)) == 1


def test_png_sizes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0")
    (tmp_path / "b.txt").write_text("no")
    got = corpus.read_images(spark, str(tmp_path)).collect()
    assert [(r["mime"], r["width"], r["height"]) for r in got] == [("image/png", 640, 480)]


def test_config_layers(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path))
    assert config.load_config().chunk_size == 800
    (tmp_path / "config.toml").write_text('[embed]\nurl = "http://e/v1/embedding"\n[chunk]\nsize = 500\n')
    got = config.load_config()
    assert (got.chunk_size, got.embed_health_url) == (500, "http://e/v1/health")
    monkeypatch.setenv("SPARKFOLIO_CHUNK_SIZE", "300")
    assert config.load_config().chunk_size == 300


def test_vectors_of_another_length_have_no_distance(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 1.0])], "id long, embedding array<double>")
    assert [r["id"] for r in search.nearest(rows, [1.0, 0.0], 9).collect()] == [1, 4]
    assert [r["id"] for r in search.most_similar(rows, [0.0, 1.0], 9).collect()] == [4, 1]


def test_rounding_is_that_of_sql(spark):
    values = [-1e-8, 1e-8, -0.0, 0.0000005, -0.0000005, 0.1234565, -2.5000005, 1e300, None, float("nan")]
    con = duckdb.connect()
    want = con.execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 6))", [values]).fetchone()[0]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", six(F.col("v")).alias("v")).orderBy("i").collect()
    assert [str(r["v"]) for r in got] == [str(w) for w in want]


def test_chunks_leave_the_worker_in_small_batches():
    texts = ["word " * 300_000, None, "", "short", "a b. " * 2000]
    batch = pa.record_batch({"page": pa.array(range(5)), "full_text": pa.array(texts)})
    out = list(chunking._chunk_batches("full_text", ["page"], (800, 200, True), 1 << 16)(iter([batch])))
    assert len(out) > 20 and max(b.nbytes for b in out) < 1 << 17
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(i, *c) for i, t in enumerate(texts) for c in chunking.chunk_text(t)]
