import itertools
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import lexical
from sparkfolio.operators import posting_index, search
from sparkfolio.operators.posting_index import PostingIndex
from sparkfolio.sources.versions import Versions

WORDS = "map river glacier ice snow model chart table figure error mean rate north south".split()


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, int(rng.integers(1, 25)), p=np.arange(14, 0, -1) / 105)) for _ in range(n)]


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "id long, content string").withColumn("tsv", lexical.vector_column(F.col("content")))


def same(index, rows, query, limit, **more):
    lexemes = lexical.query_lexemes(query)
    want = [(r["id"], round(r["rank"], 12)) for r in search.lexical_matches(rows, query, limit).collect()]
    found = index.search(lexemes, limit, **more)
    assert [(r["id"], round(r["rank"], 12)) for r in found.collect()] == want, query
    return found


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(posting_index, "RANGE_BITS", 4)


def test_best_rows_equal_a_scan_with_few_ranges_looked_at(spark, tmp_path, small):
    pairs = [(i * 3 + 2**40, t) for i, t in enumerate(texts(400))] + [(-5, "glacier glacier map"), (7, None)]
    rows = rows_of(spark, pairs).cache()
    index = PostingIndex(spark, str(tmp_path))
    index.add(rows)
    for query in ("glaciers", "map glacier", "ice snow models", "south", "map of the river", "the of"):
        found = same(index, rows, query, 5, first=2)
    found = same(index, rows, "maps", 1, first=2)
    ranges, first, rest = found._ranges
    assert first + rest.count() < 0.5 * ranges.count()
    assert index.search(["nowhere"], 5).count() == 0
    same(index, rows, "north rate", 1000)


def test_segments_deletions_and_compaction(spark, tmp_path, small):
    all_texts = texts(120, 1)
    index = PostingIndex(spark, str(tmp_path))
    assert index.search(["map"], 5).count() == 0
    index.add(rows_of(spark, list(enumerate(all_texts[:60]))))
    index.add(rows_of(spark, [(i, t) for i, t in enumerate(all_texts)][60:]))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 120, 4)], "id int"))
    left = {i: t for i, t in enumerate(all_texts) if i % 4}
    index.add(rows_of(spark, [(4, "glacier map glacier"), (8, "map")]))  # deleted ids come again
    left |= {4: "glacier map glacier", 8: "map"}
    rows = rows_of(spark, list(left.items())).cache()
    for query in ("glacier", "map glacier", "snow ice map"):
        same(index, rows, query, 7, first=1)
    index.compact()
    assert len(index.versions.parts()) == 1
    for query in ("glacier", "map glacier", "snow ice map"):
        same(index, rows, query, 7, first=1)


def test_a_query_reads_the_folders_of_its_lexemes(spark, tmp_path):
    index = PostingIndex(spark, str(tmp_path))
    index.add(rows_of(spark, list(enumerate(texts(50)))))
    parts = index.versions.parts()
    part = spark.range(1).select(posting_index.lexeme_part(F.lit("map"))).first()[0]
    files = index._read(parts, [part]).inputFiles()
    assert files and all(f"lexeme_part={part}/" in f for f in files) and len(files) < len(index._read(parts).inputFiles())


def test_writers_at_the_same_time_lose_no_version(spark, tmp_path):
    root = str(tmp_path / "v")
    writers = [threading.Thread(target=lambda k=k: [Versions(spark, root).commit(lambda parts: [*parts, f"{k}-{i}"]) for i in range(6)]) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    versions = Versions(spark, root)
    assert versions.numbers() == list(range(1, 25))
    assert sorted(versions.parts()) == sorted(f"{k}-{i}" for k in range(4) for i in range(6))
    assert len(versions.parts(3)) == 3
    with pytest.raises(ValueError):
        versions.parts(99)


def test_equal_ranks_stay_in_order_of_id(spark, tmp_path, small):
    """Three lexemes in all orders: the same factors, multiplied in another order."""
    pairs = [(i, " ".join(w)) for i, w in enumerate(list(itertools.permutations(["map", "ice", "snow"])) * 30)]
    rows = rows_of(spark, pairs).repartition(3).cache()
    index = PostingIndex(spark, str(tmp_path))
    index.add(rows)
    ranks = {r["id"]: round(r["rank"], 9) for r in index.search(["ice", "map", "snow"], 180).collect()}
    best = [i for i in sorted(ranks, key=lambda i: (-ranks[i], i))][:40]
    assert [r["id"] for r in index.search(["ice", "map", "snow"], 40, first=2).collect()] == best
    assert [r["id"] for r in search.lexical_matches(rows, "map ice snow", 40).collect()] == best
