"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkfolio.llm import exact_dedup, language, link_filter, mixing, ogg, quality, repeats, repetition, secrets, sentencepiece, simhash

LONG = "A long text of many words, token = abcdefgh1234 and more. " * 4000
ROWS = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, "ONE two three four five six"), (None, "no id here at all"), (5, LONG), (6, LONG), (7, "12 34 !!"), (8, None), (9, "zwei und drei Wörter für Äpfel")]

OPERATORS = {
    "secrets": lambda d: secrets.find_secrets(d),
    "exact": lambda d: exact_dedup.exact_duplicates(d),
    "pieces": lambda d: sentencepiece.encode_documents(d),
    "mix": lambda d: mixing.mix(d),
    "language": lambda d: language.identify_language(d),
    "quality": lambda d: quality.score_quality(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))),
    "ogg": lambda d: ogg.ogg_digests(d),
    "repeats": lambda d: repeats.remove_repeats(d),
    "simhash": lambda d: simhash.simhash_groups(d),
    "repetition": lambda d: repetition.judge_repetition(d),
}


@pytest.fixture(scope="module")
def edges(make):
    return make(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_input_row(edges, name):
    out = OPERATORS[name](edges).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(make, edges, name):
    assert OPERATORS[name](edges.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["secrets", "pieces", "language", "quality", "ogg", "repeats", "repetition"])
def test_equal_texts_have_equal_values(edges, name):
    rows = {}
    for r in OPERATORS[name](edges).collect():
        rows.setdefault(r["doc_id"], []).append({k: v for k, v in r.asDict().items() if k not in ("doc_id", "held_out")})
    assert rows[5] == rows[6] and rows[1] == rows[2] == rows[8] and rows[3][0] == rows[3][1]


def test_defined_results(edges):
    exact = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(edges).collect()}
    assert (exact[1]["keep_id"], exact[1]["group_size"], exact[8]["kept"]) == (8, 3, True)
    assert (exact[3]["keep_id"], exact[3]["group_size"]) == (4, 3)
    assert exact[None]["kept"] is True
    lang = {r["doc_id"]: r for r in language.identify_language(edges).collect()}
    assert {lang[i]["lang_pred"] for i in (1, 2, 7, 8)} == {"und"} and lang[1]["score"] == 0.0
    near = {r["doc_id"]: r for r in simhash.simhash_groups(edges).collect()}
    assert near[1]["fingerprint"] == "0" * 16 and near[8]["component_id"] == 1 and near[6]["component_id"] == 5 and near[None]["component_id"] is None
    kept = {r["doc_id"]: r for r in repeats.remove_repeats(edges).collect()}
    assert kept[5]["n_removed"] == kept[5]["n_bytes"] == len(LONG) and kept[3]["n_removed"] == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href=x>"), (3, "http://A.Net", None), (3, "http://A.Net", None), (4, "http://x.example.net/en/a?q#f", ""), (5, "https://b.org/fr/", "<a href='//A.net/z'>"), (6, "http://ok.test?x/y", "<A HREF=http://b.org/>")]
    pages = spark.createDataFrame([(*r, 0.5, "k") for r in rows], "page_id long, url string, html string, trust double, kind string")
    out = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in link_filter.judge_pages(pages).collect()), key=str)
    assert out == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.net", "", None, "allow"), (3, "a.net", "", None, "allow"),
        (4, "x.example.net", "/en/a", "example.net/en/", "allow"), (5, "b.org", "/fr/", "org/fr/", "allow"), (6, "ok.test", "", None, "allow"),
    ]
    assert link_filter.judge_pages(pages.limit(0)).count() == 0


def test_stages_keep_columns_and_survive_edges(spark, edges, sf):
    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = out.checkpoint()
    assert docs.where("doc_id in (1, 2, 7, 8)").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_long_texts_go_piece_by_piece_with_the_same_results(monkeypatch):
    import numpy as np

    text = ("Ein Text mit Wörtern, " * 40 + "\n  and more  words of it ▁ x " * 30) * 3
    raw = np.frombuffer(text.encode(), np.uint8)
    off = np.array([0, len(raw)])

    whole = simhash.fingerprints([text, "a b c d"])
    monkeypatch.setattr(simhash, "BLOCK", 50)
    assert simhash.fingerprints([text, "a b c d"]).tolist() == whole.tolist()

    whole = exact_dedup.fingerprints(raw, off, 64)
    monkeypatch.setattr(exact_dedup, "CHUNKS", 3)
    assert exact_dedup.fingerprints(raw, off, 64) == whole

    pieces = sentencepiece.Pieces.load()
    whole = pieces.encode([text])[0].tolist()
    for size in (1, 100, 777):
        monkeypatch.setattr(sentencepiece, "PIECE", size)
        monkeypatch.setattr(sentencepiece.pieces_of, "__defaults__", (size,))
        assert pieces.encode([text, ""])[0].tolist() == whole

    windows = lambda got: sorted((p, a, k) for _, b, n, a, k in zip(*got) for p in range(b, b + n))
    assert windows(repeats.segments(raw, off, 60, 12, piece=500)) == windows(repeats.segments(raw, off, 60, 12))

    mil = quality.AttentionMil.new()
    counts, n = quality.passages(raw, off)
    assert mil.forward(quality.features(counts), n)[0] == pytest.approx(mil.pool(mil.encode(quality.features(counts)), n)[0])


def test_stages_keep_columns_with_the_names_they_use_inside(spark, make, sf):
    names = ["language_id", "mix_source", "mix_repeats", "mix_under", "mix_taken", "mix_time", "__language", "__mix_s", "__mix_r", "__mix_u", "__mix_n", "__mix_k", "without_th", "again_th"]
    docs = make([(i, f"these are the words of text number {i} and {i * 7} more of them") for i in range(12)], ", ".join(f"{n} string" for n in ("fp", "key"))).select("*", *[F.col("doc_id").cast("string").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r[n] == str(r["doc_id"]) for r in out.collect() for n in names), name
