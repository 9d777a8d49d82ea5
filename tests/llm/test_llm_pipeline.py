import pyarrow as pa

import corpus_pipeline
import __spark_entry__
from sparkfolio.llm import language, mixing, sentencepiece
from sparkfolio.llm.common import utf8

from test_llm_near_copies import slow_groups


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    _, stage = corpus_pipeline.STAGES[0]
    kept = stage(spark, docs, sf).checkpoint()
    model = language.train_language(docs)
    rows = docs.collect()
    names, scores = zip(*((n[0], x[0]) for n, x in (model.predict(*utf8(pa.array([r["text"]], pa.string()))) for r in rows)))
    assert plain(kept) == sorted((tuple(r) for r, n, s in zip(rows, names, scores) if n != "und" and s >= corpus_pipeline.LEAST_SCORE), key=str)

    unique = corpus_pipeline.STAGES[1][1](spark, kept, sf).checkpoint()
    best = {}
    for r in kept.collect():
        best[fold(r["text"])] = max(best.get(fold(r["text"]), r), r, key=lambda x: x["doc_id"])
    assert plain(unique) == sorted(map(tuple, best.values()), key=str)

    far = corpus_pipeline.STAGES[2][1](spark, unique, sf).checkpoint()
    rows = unique.collect()
    group = slow_groups([(r["doc_id"], r["text"]) for r in rows])
    assert plain(far) == sorted((tuple(r) for r in rows if group[r["doc_id"]] == r["doc_id"]), key=str)

    mixed = corpus_pipeline.STAGES[3][1](spark, far, sf).checkpoint()
    times = {r["doc_id"]: r["times"] for r in mixing.mix(far).collect()}
    assert plain(mixed) == sorted((tuple(r) for r in far.collect() for _ in range(times[r["doc_id"]])), key=str)

    encoded = corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect()
    pieces, text = sentencepiece.Pieces.load(), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(encoded) == mixed.count() and all(pieces.decode(r["ids"]) == text[r["doc_id"]] for r in encoded)


def test_run_is_the_stages_in_turn(spark, sf):
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == ["doc_id", "ids", "n_tokens", "n_byte_tokens", "decoded_sha256", "lossless"] and whole.count() > 0
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
