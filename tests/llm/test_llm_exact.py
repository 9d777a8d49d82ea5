import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from sparkfolio.llm import exact_dedup as E
from sparkfolio.llm import queries


def naive(data, primes=E.PRIMES):
    out = [0] * len(primes)
    for b in data:
        out = [(h * B + b) % p for h, B, p in zip(out, E.BASES, primes)]
    return len(data), tuple(out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=6), st.integers(1, 64))
def test_chunked_fingerprints_are_those_of_the_whole(texts, chunk):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    assert E.fingerprints(data, offsets, chunk) == [naive(t) for t in texts]


@given(st.binary(max_size=80), st.binary(max_size=80), st.binary(max_size=80))
def test_combining_is_associative(a, b, c):
    x, y, z = map(naive, (a, b, c))
    assert E.combine(E.combine(x, y), z) == E.combine(x, E.combine(y, z)) == naive(a + b + c)


def expected(rows):
    groups = {}
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    return sorted((i, max(groups[fold(t)]), len(groups[fold(t)])) for i, t in rows)


@pytest.mark.parametrize("primes", [E.PRIMES, (13, 7)])
def test_groups_are_those_of_equal_texts_even_when_fingerprints_collide(make, primes):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("aAbB É") for _ in range(rng.randrange(4)))) for i in range(600)]
    out = E.exact_duplicates(make(rows), primes=primes).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == expected(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)


def test_a_large_group_is_dealt_over_salts(make, monkeypatch):
    monkeypatch.setattr(E, "SALT_ROWS", 5)
    rows = [(i, "Same text" if i % 3 else f"text {i}") for i in range(120)]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in E.exact_duplicates(make(rows)).collect()) == expected(rows)


@pytest.mark.parametrize("primes", [E.PRIMES, (13, 7)])
def test_huge_texts_are_hashed_in_parts_and_rows_without_an_id_are_compared(make, primes):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3, i]), "".join(rng.choice("aAé ") for _ in range(rng.randrange(12)))) for i in range(200)]
    whole = E.exact_duplicates(make(rows), primes=primes).collect()
    parts = E.exact_duplicates(make(rows), primes=primes, huge=3).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if c in "A" else c for c in t), []).append(-1 if i is None else i)
    want = sorted((-1 if i is None else i, max(g), len(g)) for i, t in rows for g in [groups["".join(c.lower() if c in "A" else c for c in t)]])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in whole) == want


def test_names_that_clash_with_those_used_inside(spark):
    names = "doc_id long, text string, th long, without_mark boolean, again_id long, kept string, __maybe int"
    docs = spark.createDataFrame([(i, t, 5, True, 9, "k", 3) for i, t in [(1, "a"), (1, "a"), (2, "A"), (None, "b"), (None, "b"), (3, "c")]], names)
    out = E.drop_exact_duplicates(docs)
    assert out.columns == docs.columns and out.where("th = 5 and without_mark and again_id = 9 and kept = 'k' and __maybe = 3").count() == 3


def test_one_of_each_group_stays(make):
    rows = [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (4, None), (5, ""), (6, "c"), (6, "a")]
    out = E.drop_exact_duplicates(make(rows))
    assert sorted((r["doc_id"], (r["text"] or "").lower()) for r in out.collect()) == [(3, "b"), (5, ""), (6, "a"), (6, "c")]


def test_query_matches_sql(spark, sf):
    oracle.same(queries.QUERIES["op2_exact_dedup"](spark, sf), oracle.connect(sf), queries.ORACLE_SQL["op2_exact_dedup"])
