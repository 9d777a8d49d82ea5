import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import language as L
from sparkfolio.llm import quality as Q
from sparkfolio.llm import queries
from sparkfolio.llm.words import PieceCache


def numeric(loss, part, place, step=1e-3):
    old = part[place]
    part[place] = old + step
    up = loss()
    part[place] = old - step
    down = loss()
    part[place] = old
    return (up - down) / (2 * step)


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    net = L.BiGru.new(3, hidden=4, seed=1)
    for group in (net.table, net.recur, net.bias):
        group[:] = [p.astype(np.float64) for p in group]
    net.out, net.out_bias = net.out.astype(np.float64) * 5, net.out_bias.astype(np.float64)
    x = rng.integers(0, 5, (7, 6))
    target = rng.dirichlet(np.ones(3), 6).T
    weight = rng.random(x.shape)
    _, grads = net.gradients(x, target, weight)
    for part, grad in zip(net.parts(), grads):
        for _ in range(6):
            place = tuple(rng.integers(0, 5 if part.ndim == 2 and part.shape[1] == 257 and i == 1 else n) for i, n in enumerate(part.shape))
            assert grad[place] == pytest.approx(numeric(lambda: net.gradients(x, target, weight)[0], part, place, 1e-4), rel=0.05, abs=2e-5)


def by_byte(net, raw):
    """Mean distribution of a text's bytes, by scalar steps byte after byte in each window."""
    hidden = net.recur[0].shape[1]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    symbol = lambda i: raw[i] if 0 <= i < len(raw) else L.EDGE

    def step(k, h, s):
        given, back = net.table[k][:, s].astype(float), net.recur[k].astype(float) @ h
        z, r = sigmoid(given[:hidden] + back[:hidden]), sigmoid(given[hidden : 2 * hidden] + back[hidden : 2 * hidden])
        c = np.tanh(given[2 * hidden :] + r * (back[2 * hidden :] + net.bias[k]))
        return z * h + (1 - z) * c

    total = 0
    for start in range(0, len(raw), L.WINDOW):
        stop = min(len(raw), start + L.WINDOW)
        ahead, behind = {}, {}
        h = np.zeros(hidden)
        for i in range(start - L.CONTEXT, stop):
            ahead[i] = h = step(0, h, symbol(i))
        h = np.zeros(hidden)
        for i in reversed(range(start, stop + L.CONTEXT)):
            behind[i] = h = step(1, h, symbol(i))
        for i in range(start, stop):
            v = np.exp(net.out.astype(float) @ np.concatenate([ahead[i], behind[i]]) + net.out_bias)
            total = total + v / v.sum()
    return total / len(raw)


def test_documents_by_a_loop_over_bytes(monkeypatch):
    net = L.BiGru.new(3, seed=5)
    net.out *= 20
    raw = [t.encode() for t in ("", "a", "né à " * 100, "x" * 500, "one two three\n" * 31, "z" * L.WINDOW)]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    model = L.LanguageModel(["a", "b", "c"], net)
    sums = model.sums(data, off)
    for text, got in zip(raw[1:], sums[1:]):
        assert got / len(text) == pytest.approx(by_byte(net, text), abs=1e-4)
    monkeypatch.setattr(L, "WINDOWS", 1)
    assert model.sums(data, off) == pytest.approx(sums, rel=1e-4)


def test_a_text_without_blanks_and_a_mixed_one(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = L.train_language(spark.read.parquet(f"{sf}/documents.parquet"))
    held = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 == 2 and len(t) > 200]
    raw = ["".join(t.split()).encode() for t, _ in held]
    names, _ = model.predict(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert sum(a == k for a, (_, k) in zip(names, held)) >= 0.9 * len(held)
    one = {k: t.encode() for t, k in held}
    both = one["en"][:300] + b" " + one["es"][:2000]
    names, scores = model.predict(np.frombuffer(both, np.uint8), np.array([0, len(both)]))
    assert names == ["es"] and scores[0] < 1


def test_gradients_of_attention():
    rng = np.random.default_rng(0)
    model = Q.AttentionMil.new()
    model.parts = [p.astype(np.float64) for p in model.parts]
    count = np.array([1, 4, 2])
    x, y = rng.random((7, Q.FEATURES)) / 4, np.array([1, 0, 1])

    def loss():
        p = model.forward(x, count)[0]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for part, grad in zip(model.parts, model.gradients(x, count, y)):
        for _ in range(6):
            place = tuple(rng.integers(0, n) for n in part.shape)
            assert grad[place] == pytest.approx(numeric(loss, part, place), rel=1e-3, abs=1e-7)


def test_attention_finds_the_passage_that_matters():
    rng = np.random.default_rng(4)
    bags, y = [], []
    for i in range(400):
        n = int(rng.integers(1, 6))
        counts = np.zeros((n, Q.FEATURES), np.int64)
        counts[:, 97:107] = rng.integers(1, 60, (n, 10))
        counts[:, Q.WORDS] = 80
        if i % 2:
            counts[int(rng.integers(0, n)), 35] = 120  # one odd passage makes the document a bad one
        bags.append(Q.features(counts))
        y.append(1 - i % 2)
    model = Q.AttentionMil.train(bags[:300], np.array(y[:300]))
    p, state = model.forward(np.concatenate(bags[300:]), np.array([len(b) for b in bags[300:]]))
    assert ((p >= 0.5) == np.array(y[300:])).mean() > 0.9


def test_passages_cover_whole_texts():
    texts = ["", "ab ab ab x x\ny", "é" * 700, "z" * 1024]
    raw = [t.encode() for t in texts]
    counts, n = Q.passages(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert n.tolist() == [1, 1, 3, 2] and counts[:, :256].sum() == sum(map(len, raw))
    assert (counts[1, Q.WORDS], counts[1, Q.REPEATED]) == (6, 3)


def test_languages_of_held_out_documents(spark, sf):
    rows = queries.QUERIES["op6_language_id"](spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_labels_of_the_held_out_fold_are_never_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(L.remainder(F.col("doc_id"), 4) == 2, "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, L.identify_language(docs).collect())) == sorted(map(tuple, L.identify_language(spoilt).collect()))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(L.remainder(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, Q.score_quality(docs, labels).collect())) == sorted(map(tuple, Q.score_quality(docs, turned).collect()))


def test_quality_of_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES["op7_quality_mil"](spark, sf).collect() if r["held_out"] and r["doc_id"] in quality]
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in held)
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_cut_caches():
    cache = PieceCache(lambda pieces: np.array([[len(p)] for p in pieces]), most=3)
    for pieces in (["a", "bb", "a"], ["ccc", "bb", "d", "ee"], ["a", "fff"]):
        rows = cache.numbers(pieces)
        assert cache.rows[rows][:, 0].tolist() == [len(p) for p in pieces]


def test_quality_scores_passage_by_passage(documents, spark, sf):
    """Each document's score again, one passage and one unit at a time."""
    import math
    import re

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.train_quality(documents, labels, steps=60)
    w, b, wv, wu, wa, wc, bc = [p.astype(np.float64) for p in model.parts]
    got = {r["doc_id"]: r["score"] for r in Q.score_quality(documents, labels, model=model).collect()}
    for r in documents.orderBy("doc_id").limit(60).collect():
        raw = (r["text"] or "").encode()
        hidden, attention = [], []
        words = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        for a in range(0, max(len(raw), 1), Q.PASSAGE):
            part = raw[a : a + Q.PASSAGE]
            starts = [i for i, (at, _) in enumerate(words) if a <= at < a + Q.PASSAGE]
            x = np.zeros(Q.FEATURES)
            for byte in part:
                x[byte] += 1
            x[:256] = np.sqrt(x[:256] / max(1, len(part)))
            x[Q.WORDS] = bool(starts)
            x[Q.REPEATED] = 2 * math.sqrt(sum(i > 0 and words[i][1] == words[i - 1][1] for i in starts) / max(1, len(starts)))
            h = np.tanh(x @ w + b)
            hidden.append(h)
            attention.append(sum(math.tanh(h @ wv[:, j]) / (1 + math.exp(-(h @ wu[:, j]))) * wa[j] for j in range(len(wa))))
        weights = [math.exp(e) for e in attention]
        bag = sum(k * h for k, h in zip(weights, hidden)) / sum(weights)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-(bag @ wc + bc[0])))) < 1e-4


def test_long_documents_are_learned_from(make, monkeypatch):
    docs = make([(i, f"{'good' if i % 2 else 'bad'} words of it " * (3000 if i == 1 else 5)) for i in range(40)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    seen = []
    monkeypatch.setattr(Q.AttentionMil, "train", classmethod(lambda cls, bags, y, steps, seed=11: seen.append([len(b) for b in bags])))
    Q.train_quality(docs, labels, fold=50)
    assert max(seen[0]) == -(-len("good words of it " * 3000) // Q.PASSAGE) and len(seen[0]) > 35
    texts = []
    monkeypatch.setattr(L.LanguageModel, "train", classmethod(lambda cls, t, languages, steps=0: texts.append(t)))
    L.train_language(docs)
    assert max(len(t) for t, _ in texts[0]) == len("good words of it " * 3000)


def test_reading_takes_less_time_than_the_plain_steps_and_gives_the_same_states():
    rng = np.random.default_rng(3)
    net = L.BiGru.new(4)
    net.bias = [rng.standard_normal(L.HIDDEN).astype(np.float32) for _ in "fb"]
    x, begin = rng.integers(0, 257, (256, 512)), rng.integers(200, 257, 512)

    def plain(k, h=L.HIDDEN):
        """Unit by window: weights are looked up one by one, gates halved and shifted in steps of their own."""
        state, out, room = np.zeros((h, x.shape[1]), np.float32), np.empty((len(x), h, x.shape[1]), np.float32), np.empty((3 * h, x.shape[1]), np.float32)
        for t in range(len(x)) if k == 0 else reversed(range(len(x))):
            given, back = np.take(net.table[k], x[t], axis=1, out=room, mode="clip"), net.recur[k] @ state
            gates = given[: 2 * h]
            gates += back[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            inner = back[2 * h :]
            inner += net.bias[k][:, None]
            c = np.tanh(given[2 * h :] + gates[h:] * inner)
            new = out[t]
            np.subtract(state, c, out=new)
            new *= gates[:h]
            new += c
            if k and t >= begin.min():
                new *= t < begin
            state = new
        return out

    for k in (0, 1):
        assert np.abs(net.states(x, k, begin if k else None) - plain(k)).max() < 1e-5
    assert np.abs(net.states(x, 0, trace=[]) - net.states(x, 0)).max() < 1e-5
    took = {"plain": [], "states": []}
    for _ in range(15):
        for name, work in (("plain", plain), ("states", lambda k: net.states(x, k))):
            at = time.process_time()
            work(0)
            took[name].append(time.process_time() - at)
    assert min(took["states"]) < 0.93 * min(took["plain"]), took
