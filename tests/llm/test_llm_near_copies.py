import random

import numpy as np
import pytest

import corpus_pipeline
from sparkfolio.llm import near_copies as steps
from sparkfolio.llm.near_copies import drop_near_copies, near_copies


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def slow_groups(rows):
    """Smallest id reachable from each id over pairs of similarity 0.8 or more."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    near = [(i, j) for i, a in sets for j, b in sets if i < j and len(a & b) * 5 >= 4 * len(a | b)]
    for _ in label:
        before = dict(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label
    return label


@pytest.mark.parametrize("limit", [4096, 3])
def test_groups_are_those_of_brute_force_jaccard(make, limit):
    rng = random.Random(limit)
    line = [f"line{i}" for i in range(30)]
    rows = [(0, ""), (1, " \t"), (2, None), (3, "one two"), (4, "ONE  two"), (5, "one two three")]
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))] + rng.choice([[], line])
        for _ in range(rng.randrange(1, 7)):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"x{rng.randrange(99)}"]
    want = slow_groups(rows)
    assert len(set(want.values())) < len(rows) - 20
    found = {r["doc_id"]: r["component_id"] for r in near_copies(make(rows).repartition(3), limit=limit).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == want


def test_stage_drops_all_near_copies_of_the_table(spark, sf):
    docs = corpus_pipeline.exact_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).checkpoint()
    want = slow_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect())
    assert kept == sorted(i for i, least in want.items() if i == least) and len(kept) < len(want)


def test_rows_that_repeat_an_id_are_rows_of_their_own(make):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (3, b), (2, b), (4, a), (None, a), (7, None), (7, ""), (None, "x y"), (None, "x y")]
    out = sorted(((r["doc_id"], r["text"]) for r in drop_near_copies(make(rows)).collect()), key=str)
    assert out == sorted([(3, a), (2, b), (7, None), (None, "x y")], key=str) or out == sorted([(3, a), (2, b), (7, ""), (None, "x y")], key=str)
    found = near_copies(make(rows))
    assert found.count() == len(rows) and found.where("kept").count() == 6


def test_large_buckets_are_dealt_out_with_the_same_groups(make):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    want = slow_groups(rows)
    for limit in (4096, 7):
        found = {r["doc_id"]: r["component_id"] for r in near_copies(make(rows).repartition(3), limit=limit).collect()}
        assert found == want


@pytest.mark.parametrize("limit", [4096, 5])
def test_pairs_that_share_hundreds_of_first_shingles_are_made_once(spark, make, limit):
    rows = []
    for i in range(12):
        words = [f"w{n}" for n in range(1500)]
        words[i * 120 : i * 120 + 120] = [f"own{i}x{n}" for n in range(120)]  # two of them have a similarity of about 0.7
        rows.append((i, " ".join(words)))
    docs = make(rows).select("doc_id", "text", steps.text_hash("text").alias("th"))
    nodes = steps._documents(docs, steps.SHINGLE, steps.LEAST, None)
    shared = steps._shared_rows(nodes)
    made = steps._open_pairs(nodes, shared, spark.createDataFrame([], "node long, root long"), steps.LEAST, limit).collect()
    assert len(set(made)) == 66 and len(made) <= 80
    assert shared.count() > 2000


def test_texts_are_looked_up_and_hashed_by_one_python_worker_of_a_task(spark, make):
    rows = [(i, None if i == 3 else f"a b c d e f g h {i % 7}") for i in range(40)] + [(None, "no id at all here"), (5, "again " * 9)]
    docs = make(rows).select("doc_id", "text", steps.text_hash("text").alias("th"))
    wanted = docs.where("doc_id % 3 = 0 or doc_id is null or doc_id = 5").selectExpr("monotonically_increasing_id() as node", "doc_id as in_id", "th as in_th")
    sets = steps._set_rows(docs, wanted.localCheckpoint(), steps.SHINGLE)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert sets.count() == 17 and {len(r["hashes"]) // 8 for r in sets.collect()} == {1, 5}
    assert all(list(np.frombuffer(r["hashes"], np.uint64)) == sorted(np.frombuffer(r["hashes"], np.uint64)) for r in sets.collect())
