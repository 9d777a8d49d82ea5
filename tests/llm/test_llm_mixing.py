import random

import oracle
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import mixing, queries


def shared(sizes, weights=mixing.WEIGHTS):
    """Targets by rounds of sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        over = sum(weight[s] for s in names if s not in stopped)
        target = {s: 3.0 * sizes[s] if s in stopped else weight[s] * left / over for s in names}
        more = {s for s in names if target[s] > 3 * sizes[s]}
        if not more:
            return target
        stopped |= more


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_sharing_in_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {**{f"s{i}": rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(9)}, None: 40, "É": 3}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = shared(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_taken_words_come_near_their_targets_and_reruns_agree(spark, make):
    rng = random.Random(5)
    docs = make([(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(40)))) for i in range(900)])
    docs = docs.withColumn("source", F.when(F.col("doc_id") < 600, "a").when(F.col("doc_id") < 620, "b").otherwise(F.col("source")))
    rows = mixing.mix(docs).collect()
    by_target = {}
    for r in rows:
        assert r["size"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["target"], r["source_size"]), []).append(r)
    for (target, size), part in by_target.items():
        assert sum(r["size"] for r in part) == size
        assert abs(sum(r["taken"] for r in part) - target) <= 20.5
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    counted = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in counted} == {r["doc_id"]: r["times"] for r in rows if r["times"]}


def test_a_larger_budget_keeps_what_a_smaller_one_took(spark, make):
    docs = make([(i, "w " * (i % 11 + 1)) for i in range(400)])
    few = {r["doc_id"]: r["times"] for r in mixing.mix(docs, weights=(5, 1, 1)).collect()}
    more = {r["doc_id"]: r["times"] for r in mixing.mix(docs, weights=(5, 2, 1)).collect()}
    grown = [d for d in few if d % 3 and d % 2]  # the source that the second weight falls to
    assert all(more[d] >= few[d] for d in grown)


def test_query_matches_sql_and_has_no_python(spark, sf, capsys):
    df = queries.QUERIES["op5_source_mix"](spark, sf)
    oracle.same(df, oracle.connect(sf), queries.ORACLE_SQL["op5_source_mix"])
    df.explain()
    assert "Python" not in capsys.readouterr().out
