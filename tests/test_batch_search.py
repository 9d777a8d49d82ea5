import gc
import tracemalloc
from math import exp, sqrt
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.functions import lexical, positions
from sparkfolio.operators import batch_search, chunking, providers, search

EMBED = providers.HashingEmbedder()


def slow_rank(places):
    """One pair of places at a time."""
    if len(places) == 1:
        return 0.1 * sum(1 / j**2 for j in range(1, len(places[0]) + 1)) / 1.64493406685
    out = -1.0
    for i, a in enumerate(places):
        for b in places[i + 1 :]:
            for x in a:
                for y in b:
                    d = abs(x - y)
                    w = sqrt(0.01 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * exp(d / 1.5 - 2))))
                    out = w if out < 0 else 1 - (1 - out) * (1 - w)
    return max(out, 0.0)


@pytest.mark.parametrize("pairs", [7, 1 << 20])
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.lists(st.integers(1, 300), min_size=1, max_size=9), min_size=n, max_size=n), min_size=1, max_size=6)))
def test_rank_kernel_equals_pair_by_pair(pairs, rows):
    before, positions.PAIRS = positions.PAIRS, pairs
    try:
        got = positions.ranks_of_places(pa.array([None, *rows, None])).to_pylist()
    finally:
        positions.PAIRS = before
    assert got[0] is None and got[-1] is None
    assert got[1:-1] == pytest.approx([slow_rank(r) for r in rows], abs=1e-12)
    assert lexical.rank(rows[0]) == pytest.approx(slow_rank(rows[0]), abs=1e-12)


def test_rank_of_no_rows():
    assert positions.ranks_of_places(pa.array([], pa.list_(pa.list_(pa.int32())))).to_pylist() == []
    assert positions.ranks_of_places(pa.array([None, None], pa.list_(pa.list_(pa.int32())))).to_pylist() == [None, None]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    words = "map river glacier ice snow model chart table figure error mean rate north south".split()
    prose = lambda n: " ".join(rng.choice(words, n))
    documents = spark.createDataFrame([(i, f"doc{i}", f"Doc {i}") for i in range(4)], "id int, slug string, title string")
    pages = spark.createDataFrame([(10 + i, i % 4, i) for i in range(12)], "id int, document_id int, page_number int")
    texts = [prose(12) for _ in range(160)]
    texts[40:60] = [texts[0]] * 20  # equal rows, told apart by id
    chunks = spark.createDataFrame([(i, (i % 12) % 4, 10 + i % 12, t, i, EMBED([t])[0] if i % 9 else None) for i, t in enumerate(texts)], "id int, document_id int, page_id int, content string, chunk_index int, embedding array<double>")
    chunks = chunks.withColumn("tsv", lexical.vector_column(F.col("content"))).repartition(5)
    rows = [(i, (i % 12) % 4, 10 + i % 12, "figure", f"Fig {i}", prose(4), prose(3) if i % 2 else "", EMBED([prose(3)])[0]) for i in range(50)]
    elements = spark.createDataFrame(rows, "id int, document_id int, page_id int, element_type string, label string, description string, search_text string, embedding array<double>")
    elements = elements.withColumns({"crop_path": F.lit("c.png"), "rendered_path": F.lit(""), "tsv": lexical.vector_column(F.concat_ws(" ", "label", "description", "search_text"))})
    return search.Corpus(documents, pages, chunks.cache(), elements.cache())


def slow_search(corpus, query, limit, slug, exact):
    """Branch by branch with the single operators, fused: what a query is by definition."""
    short = search.keywords(query)
    kinds = [corpus.chunk_rows(slug), corpus.element_rows(slug)]
    branches = [search.nearest(rows, EMBED([w])[0], limit) for w in [query] + ([short] if short != query and len(short) > 2 else []) for rows in kinds]
    branches += [search.lexical_matches(rows, w, limit, exact) for w in [query] + ([short] if short != query else []) for rows in kinds]
    return [(r["source_type"], r["id"], round(r["score"], 9)) for r in search.fuse(branches, limit, 1.3, search.KEPT).orderBy("score", "first_seen").collect()]


QUERIES = ["what is the glacier map", "models of ice", "map", "", "the of", "unknownword", "what does the table show about errors in the mean", "river's"]


@pytest.mark.parametrize("exact", [False, True])
def test_a_batch_equals_its_queries_one_by_one(spark, corpus, exact):
    rows = [(f"q{i}", q, f"doc{i % 3}" if i % 2 else None) for i, q in enumerate(QUERIES)] + [("none", "map", "no such document"), ("null", None, None)]
    asked = spark.createDataFrame(rows, "query_id string, query string, document_slug string")
    calls = []
    embed_all = lambda wordings: calls.append(wordings) or [EMBED([w])[0] for w in wordings]
    out = batch_search.search_batch(corpus, asked, embed_all, 6, max_distance=1.3, exact_words=exact, block=4)
    assert out.columns == ["query_id", "rank", *search.RESULT, "first_seen"]
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["source_type"], r["id"], round(r["score"], 9)))
    for name, query, slug in rows:
        want = [] if name == "none" else slow_search(corpus, query or "", 6, slug, exact)
        assert got.get(name, []) == want, name
    assert len(calls) == 3 and all(len(set(c)) == len(c) for c in calls)


def test_single_search_is_a_batch_of_one_and_scans_each_kind_once(corpus):
    found = search.search(corpus, QUERIES[0], lambda q: EMBED([q])[0], 6, max_distance=1.3)
    assert [(r["source_type"], r["id"], round(r["score"], 9)) for r in found.collect()] == slow_search(corpus, QUERIES[0], 6, None, False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("InMemoryRelation") == 2


def test_many_equal_vectors_are_ranked_by_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 5 else [0.0, 1.0]) for i in range(500)], "id long, embedding array<double>").orderBy(F.desc("id"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert sorted(r["id"] for r in search.knn_join(rows, queries, 5).collect()) == [1, 2, 3, 4, 6]


def test_empty_corpus_and_no_queries(spark, corpus):
    nothing = search.Corpus(corpus.documents, corpus.pages, corpus.chunks.limit(0), corpus.elements.limit(0))
    assert search.search(nothing, "map", lambda q: EMBED([q])[0]).count() == 0
    asked = spark.createDataFrame([], "query_id long, query string")
    assert batch_search.search_batch(corpus, asked, lambda w: [EMBED([x])[0] for x in w]).count() == 0


def test_queries_of_one_text_are_answered_once(spark, corpus):
    asked = spark.createDataFrame([(i, "map of the glacier" if i % 3 else "ice") for i in range(30)], "query_id long, query string")
    calls = []
    out = batch_search.search_batch(corpus, asked, lambda w: calls.append(w) or [EMBED([x])[0] for x in w], 4, max_distance=1.3, block=2).collect()
    of = lambda i: sorted((r["rank"], r["source_type"], r["id"], r["score"]) for r in out if r["query_id"] == i)
    assert len(calls) == 1
    assert of(0) and of(1) and all(of(i) == of(1 if i % 3 else 0) for i in range(30))


def test_texts_become_position_vectors_in_the_worker_that_searches_them(corpus):
    chunks = corpus.chunks.withColumn("tsv", F.when(F.col("id") != 3, F.col("content")))
    elements = corpus.elements.withColumn("tsv", F.concat_ws(" ", "label", "description", "search_text"))
    worded = search.Corpus(corpus.documents, corpus.pages, chunks, elements)
    without = search.Corpus(corpus.documents, corpus.pages, corpus.chunks.where("id <> 3"), corpus.elements)
    for query in QUERIES[:3]:
        ask = lambda of: search.search(of, query, lambda q: None, 6, max_distance=1.3)  # noqa: B023, E731
        found = ask(worded)
        assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in ask(without).collect()] != []


@pytest.mark.parametrize("batches, texts", [(40, 1), (1, 40)])
def test_memory_of_a_search_does_not_grow_with_its_rows(batches, texts):
    """Chunker and search of exact words in a row, over five times and more the input, in more batches or in longer ones."""
    asked, rng, slice_bytes = batch_search.Asked(), np.random.default_rng(0), 1 << 16
    asked.add("what the thing is", "thing", lambda q: [0.0] * 8, exact=True)
    kept = [c for c in search.KEPT if c != "score"]
    text = " ".join(rng.choice(["what", "the", "thing", "is", "map", "river"], 20_000))
    kinds = {c: pa.string() for c in kept} | {"id": pa.int64(), "document_id": pa.int64(), "page_id": pa.int64(), "chunk_index": pa.int32()}

    def pages(batches, texts):
        for i in range(batches):
            yield pa.record_batch({"id": pa.array(range(i * texts, (i + 1) * texts)), "text": pa.array([text] * texts)})

    def rows(batches, texts):
        for b in chunking._chunk_batches("text", ["id"], (800, 200, True), slice_bytes)(pages(batches, texts)):
            n = b.num_rows
            known = {"id": pc.add(pc.multiply(b.column("id"), 100_000), b.column("chunk_index").cast(pa.int64())), "content": b.column("content"), "chunk_index": b.column("chunk_index"), "document_id": pa.array([1] * n), "page_id": b.column("id"), "source_type": pa.array(["chunk"] * n)}
            vectors = pa.array([[float(i % 7)] * 8 for i in range(n)], pa.list_(pa.float32()))
            yield pa.record_batch({c: known.get(c, pa.nulls(n, kinds[c])) for c in kept} | {"embedding": vectors, "worded": pc.split_pattern(b.column("content"), " ")})

    def peak(batches, texts):
        most, before = 0, pa.default_memory_pool().bytes_allocated()

        def watched():
            nonlocal most
            for b in rows(batches, texts):
                most = max(most, pa.default_memory_pool().bytes_allocated() - before)
                yield b

        gc.collect()
        tracemalloc.start()
        try:
            found = list(batch_search._answers(SimpleNamespace(value=asked), 5, True, kept, kinds)(watched()))
            return most, tracemalloc.get_traced_memory()[1], sum(b.num_rows for b in found)
        finally:
            tracemalloc.stop()

    small, large = peak(min(batches, 8), min(texts, 8)), peak(batches, texts)
    own = len(text) * max(texts - 8, 0)  # a longer batch itself is not the worker's to bound
    assert small[2] == large[2] == 20
    assert large[0] < small[0] + own + (1 << 19) and large[1] < small[1] + (1 << 19)
