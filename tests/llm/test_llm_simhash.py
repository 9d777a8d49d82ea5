import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import simhash as S
from sparkfolio.llm.components import components
from sparkfolio.llm.queries import QUERIES


def slow_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(prints):
    """Smallest id reachable for each (id, fingerprint)."""
    up = {i: i for i, _ in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in prints}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\x1f\xa0", max_size=40), max_size=6))
def test_fingerprints(texts):
    assert S.fingerprints(texts).tolist() == [slow_fingerprint(t) for t in texts]


def test_golay_code_is_perfect():
    golay = S.Golay()
    assert len({golay._remainder(int(e)) for e in golay._error}) == 2048
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 500).astype(np.uint32)
    index = golay.decode(words)
    code = {int(i): int(i) << 11 | golay._remainder(int(i) << 11) for i in index}
    assert all((int(w) ^ code[int(i)]).bit_count() <= 3 for w, i in zip(words, index))
    counts = np.bincount(golay.keys(words)[0])
    assert counts.min() >= 1 and counts.max() == 6


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_fingerprints_at_three_bits_share_a_key(a, bits):
    b = a ^ sum(1 << i for i in bits)
    row, key = S.fuzzy_keys(np.array([a, b], np.uint64), S.Golay())
    assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


@pytest.mark.parametrize("limit", [4096, 4, 1])
def test_links_connect_what_brute_force_connects(spark, limit):
    rng = random.Random(limit)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            prints.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    prints = list(enumerate(sorted(prints)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in prints], "fp long").repartition(3)
    place = {f: i for i, f in prints}
    found = {place[r["node"] % (1 << 64)]: r["root"] for r in components(S.near_links(nodes, limit)).collect()}
    want = slow_groups(prints)
    groups = lambda label: sorted(sorted(i for i, _ in prints if label(i) == r) for r in {label(i) for i, _ in prints})
    assert groups(lambda i: found.get(i, i)) == groups(lambda i: want[i])


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = [x for x in label if any(a != b and x in (a, b) for a, b in edges)]
    assert set(found) == set(linked)
    assert len({(found[x], label[x]) for x in linked}) == len({found[x] for x in linked}) == len({label[x] for x in linked})


def test_query_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [(d["doc_id"], slow_fingerprint(d["text"] or "")) for d in docs]
    want = slow_groups(prints)
    rows = {r["doc_id"]: r for r in QUERIES["op10_simhash_groups"](spark, sf).collect()}
    assert all(rows[i]["fingerprint"] == f"{f:016x}" and rows[i]["component_id"] == want[i] for i, f in prints) and len(rows) == len(prints)
