import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import repeats as R
from sparkfolio.llm.queries import QUERIES


def brute(texts, least):
    """(removed bytes, spans, hash of the rest) of each text."""
    seen = {}
    for t in texts:
        for p in range(len(t) - least + 1):
            seen[t[p : p + least]] = seen.get(t[p : p + least], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if seen[t[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        keep = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, hashlib.sha256(keep).hexdigest()))
    return out


strings = st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=5)


@settings(max_examples=200, deadline=None)
@given(strings, st.integers(1, 6))
def test_maximal_repeats_by_brute_force(texts, least):
    want = {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + least, len(t) + 1):
                want.setdefault(t[a:b], []).append((i, a))
    maximal = []
    for s, places in want.items():
        if len(places) > 1:
            left = {texts[i][a - 1] if a else (i, a) for i, a in places}
            right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else (i, "end") for i, a in places}
            if len(left) > 1 and len(right) > 1:
                maximal.append((len(s), sorted(places)))
    assert R.maximal_repeats(texts, least) == sorted(maximal)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=8), st.text("ab", max_size=8), st.integers(1, 2)), min_size=1, max_size=7, unique_by=lambda x: (x[0], x[1])), st.integers(3, 8))
def test_anchored_repeats_by_brute_force(parts, least):
    bucket = [((a + "#" + b).encode(), len(a), n) for a, b, n in parts]
    got = R.anchored_repeats(bucket, least)
    for i, (s, at, n) in enumerate(bucket):
        whole = set(range(len(s))) if n > 1 else set()
        least_found, most_found = set(whole), set(whole)  # through the anchor at the same place; anywhere
        for p in range(len(s) - least + 1):
            for j, (o, other, _) in enumerate(bucket):
                q = p - at + other
                if j != i and p <= at < p + least and q >= 0 and o[q : q + least] == s[p : p + least]:
                    least_found |= set(range(p, p + least))
                if j != i and s[p : p + least] in o:
                    most_found |= set(range(p, p + least))
        found = set().union(*[range(a, b) for a, b in got[i]], set())
        assert least_found <= found <= most_found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80).map(lambda b: bytes(x % 4 for x in b)), min_size=1, max_size=4), st.integers(8, 20), st.integers(2, 8))
def test_segments_cover_every_window_once(texts, least, gram):
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    text, begin, count, anchor, key = R.segments(data, off, least, gram)
    windows = sorted(p for b, n in zip(begin, count) for p in range(b, b + n))
    assert windows == [off[i] + p for i, t in enumerate(texts) for p in range(len(t) - least + 1)]
    same = {}
    whole = data.tobytes()
    for b, n, a, k in zip(begin, count, anchor, key):
        for p in range(b, b + n):
            assert 0 <= a - p <= least - gram
            assert same.setdefault(whole[p : p + least], (a - p, k)) == (a - p, k)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = []
    for i in range(n):
        body = [word() for _ in range(rng.randrange(5, 120))]
        if i % 3:
            body.insert(rng.randrange(len(body)), rng.choice(passages))
        if i % 7 == 0:
            body.append("tick " * 40)
        texts.append(" ".join(body))
    return texts + [texts[1], texts[1], texts[2][10:], "x" * 300, None, ""]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {}), (3, {"most": 3}), (4, {"most": 1}), (5, {"depth_limit": -10**6, "most": 8}), (6, {"depth_limit": -10**6, "most": 2})])
def test_removal_is_that_of_brute_force(make, seed, options):
    texts = corpus(seed)
    out = {r["doc_id"]: r for r in R.remove_repeats(make(list(enumerate(texts))).repartition(5), least=60, gram=12, with_kept=True, **options).collect()}
    for i, want in enumerate(brute([(t or "").encode() for t in texts], 60)):
        r = out[i]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and r["n_bytes"] == len((texts[i] or "").encode())


def test_near_copies_of_one_passage_and_many_equal_rows_are_exact(make):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(400))
    texts = []
    for i in range(90):
        at = [rng.randrange(400) for _ in range(rng.randrange(5))]
        texts.append("".join(rng.choice("xyz") if j in at else c for j, c in enumerate(passage)) + f" tail {i}")
    rows = list(enumerate(texts)) + [(7, texts[7])] * 40  # one row many times over
    out = {}
    for r in R.remove_repeats(make(rows).repartition(5), least=100, gram=12, most=6).collect():
        out.setdefault(r["doc_id"], set()).add((r["n_removed"], r["n_spans"], r["kept_sha256"]))
    want = brute([t.encode() for _, t in rows], 100)
    assert [out[i] for i in range(len(texts))] == [{w} for w in want[: len(texts)]]
    assert len(out[7]) == 1 and want[7][0] == len(texts[7].encode())


def test_query_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([d["doc_id"] for d in docs], brute([(d["text"] or "").encode() for d in docs], 400)))
    for r in QUERIES["op9_repeat_removal"](spark, sf).collect():
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def passages(texts, words):
    """Number of stretches of each text that windows of so many words which stand in another text cover."""
    split = [(t or "").encode().split() for t in texts]
    holders = {}
    for i, w in enumerate(split):
        for p in range(len(w) - words + 1):
            holders.setdefault(tuple(w[p : p + words]), set()).add(i)
    out = []
    for w in split:
        starts = [p for p in range(len(w) - words + 1) if len(holders[tuple(w[p : p + words])]) > 1]
        out.append(sum(not k or p - starts[k - 1] > words for k, p in enumerate(starts)))
    return out


@pytest.mark.parametrize("seed, words", [(1, 20), (2, 9), (3, 31)])
def test_passages_of_words_by_brute_force(make, seed, words):
    texts = corpus(seed)
    docs = make(list(enumerate(texts))).repartition(5)
    found = {r["doc_id"]: r["n_passages"] for r in R.remove_repeats(docs, least=60, gram=12, words=words).collect()}
    want = passages(texts, words)
    assert [found[i] for i in range(len(texts))] == want and max(want) > 0


def test_passages_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([d["doc_id"] for d in docs], passages([d["text"] for d in docs], 51)))
    assert {r["doc_id"]: r["n_passages"] for r in QUERIES["op9_repeat_removal"](spark, sf).collect()} == want


def test_a_text_longer_than_a_slice():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert (R._leftmost_least(h, 40) == np.array([p + int(np.argmin(h[p : p + 40] >> np.uint64(R._LOW))) for p in range(4961)])).all()
