import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from sparkfolio.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, k=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, length, df = len(bags), sum(x for _, _, x in bags), collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag, size in bags:
            m = 25 + (75 * size * n) // length
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, c in collections.Counter(terms(text)).items() if bag[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture()
def small(monkeypatch):
    """So that there are many parts and clusters, and clusters of few postings."""
    for name, value in {"CLUSTER": 3, "PART": 600, "POSTINGS": 60, "FIRST": 1, "SAMPLE": 30}.items():
        monkeypatch.setattr(ranked, name, value)


def test_equals_its_sql(spark, sf):
    oracle.same(queries.QUERIES["op11_ranked_search"](spark, sf), oracle.connect(sf), queries.ORACLE_SQL["op11_ranked_search"])


def test_equals_brute_force_over_many_clusters(spark, make, small):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    topics = [rng.choice(words, 12) for _ in range(5)]
    docs = [(i, " ".join(rng.choice(topics[i % 5], int(rng.integers(1, 30))))) for i in range(150)]
    docs += [(200 + i, docs[7][1].upper()) for i in range(25)] + [(300, None), (301, "!?"), (None, docs[3][1]), (302, "Ünï w1 w1"), (7, docs[7][1])]
    items = [(0, " ".join(topics[0][:4])), (1, "w1 W1 unknown"), (2, None), (3, ""), (4, docs[7][1]), (4, "ünï"), (4, "Ünï ünï w2"), (None, "w3 w4 w5")]
    items = spark.createDataFrame(items, "item_id long, text string")
    assert plain(ranked.rank_documents(make(docs), items)) == slow(docs, [tuple(r) for r in items.collect()])


def test_blocks_of_items_and_larger_k(spark, make, small, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 5)
    docs = [(i, f"a{i % 7} b{i % 3} c") for i in range(40)]
    items = spark.createDataFrame([(i, f"a{i} b1 c c") for i in range(5)], "item_id int, text string")
    assert plain(ranked.rank_documents(make(docs), items, k=17)) == slow(docs, [tuple(r) for r in items.collect()], 17)


def test_clusters_below_the_bound_are_not_visited(spark, make, small):
    docs = [(i, " ".join(f"t{i % 8}x{j}" for j in range(10)) + f" common{i}") for i in range(400)]
    items = spark.createDataFrame([(i, f"t{i}x1 t{i}x2 t{i}x3") for i in range(8)], "item_id int, text string")
    index = ranked.LexicalIndex.build(make(docs))
    block = next(ranked._blocks(items))
    out = index._search(block, 10, "item_id int, rank int, doc_id long, score long")
    visits = sum(v.filter("item = -1").agg(F.sum("score")).first()[0] for v in out._visits)
    assert plain(out) == slow(docs, [tuple(r) for r in items.collect()])
    assert visits < 0.5 * 8 * index.clusters.count()  # clusters hold few topics each, so most pairs are skipped


def test_bisection_brings_documents_that_share_terms_together():
    rng = np.random.default_rng(3)
    topic = rng.integers(0, 4, 256)
    doc = np.repeat(np.arange(256), 20)
    term = topic[doc] * 50 + rng.integers(0, 50, len(doc))
    order = ranked.bisection_order(doc, term, 256, 64)
    assert sorted(order) == list(range(256))
    mixed = [len(set(topic[order[i : i + 16]])) for i in range(0, 256, 16)]
    assert np.mean(mixed) < 2 < np.mean([len(set(topic[i : i + 16])) for i in range(0, 256, 16)])
    assert ranked.bisection_order(np.zeros(0, int), np.zeros(0, int), 5, 2).tolist() == [0, 1, 2, 3, 4]


def test_every_row_with_a_term_is_indexed_once(spark, documents):
    index = ranked.LexicalIndex.build(documents)
    ids = sorted(r[0] for r in index.clusters.select(F.explode("ids")).collect())
    assert ids == sorted(r["doc_id"] for r in documents.collect() if terms(r["text"]))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, " ,;")]])
def test_nothing_to_find(spark, make, rows):
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranked.rank_documents(make(rows), items).count() == 0
    assert ranked.rank_documents(make([(1, "a b")]), items.limit(0)).count() == 0
