"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 512 bytes. Each passage is encoded from its byte frequencies, a gated attention network
weighs the passages, and the weighted sum is scored. Only documents have labels; which passages matter is
learned from them. Encoder, attention and scorer are trained together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, tidy, utf8
from .language import remainder

#: Bytes of a passage, and of a long text's piece, which holds whole passages.
PASSAGE, PIECE = 512, 1 << 21
#: Byte counts, words, and words that equal the one before.
FEATURES, WORDS, REPEATED = 258, 256, 257
ENCODED, ATTENTION = 16, 8
#: Labelled documents that are learned from: so many in the order of a hash of their ids, until together they pass so many bytes. Each is read as a whole, however long it is.
SAMPLE, SAMPLE_BYTES = 3000, 1 << 25
STEPS, BATCH, RATE = 400, 256, 0.02
THRESHOLD = 0.3


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a word starts, and whether the word before it in the same text is the same."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    opens = ~space
    opens[1:] &= space[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    opens[inner] = ~space[inner]
    start = np.flatnonzero(opens)
    if not len(start):
        return start, np.zeros(0, bool)
    place = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(data)]])))
    term = np.where(space, 0, data).astype(np.uint64) * _MIX[place & 255]
    word = np.add.reduceat(term, start)
    same = np.zeros(len(start), bool)
    same[1:] = word[1:] == word[:-1]
    same[np.searchsorted(start, inner[inner <= start[-1]])] = False
    return start, same


_MIX = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (passages, FEATURES) of all passages of the texts, and how many each text has; an empty text has one without bytes."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(size)), size)
    number = first[text] + (np.arange(len(data)) - offsets[:-1][text]) // PASSAGE
    out = np.bincount(number * FEATURES + data, minlength=int(count.sum()) * FEATURES).reshape(-1, FEATURES)
    start, same = _word_starts(data, offsets)
    out[:, WORDS] = np.bincount(number[start], minlength=len(out))
    out[:, REPEATED] = np.bincount(number[start[same]], minlength=len(out))
    return out, count


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the byte frequencies, and of the share of repeated words."""
    out = np.empty(counts.shape, np.float32)
    out[:, :WORDS] = np.sqrt(counts[:, :WORDS] / np.maximum(1, counts[:, :WORDS].sum(axis=1, keepdims=True)))
    out[:, WORDS] = counts[:, WORDS] > 0
    out[:, REPEATED] = 2 * np.sqrt(counts[:, REPEATED] / np.maximum(1, counts[:, WORDS]))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class AttentionMil:
    #: encoder and its bias; attention's two gates and its vector; scorer and its bias
    parts: list[np.ndarray]

    @classmethod
    def new(cls, seed: int = 11) -> AttentionMil:
        rng = np.random.default_rng(seed)
        shapes = [(FEATURES, ENCODED), (ENCODED,), (ENCODED, ATTENTION), (ENCODED, ATTENTION), (ATTENTION,), (ENCODED,), (1,)]
        return cls([(rng.standard_normal(s) * (0.3 if len(s) > 1 else 0.1)).astype(np.float32) for s in shapes])

    def forward(self, x: np.ndarray, count: np.ndarray):
        """x: features of all passages, count: how many each bag has (at least one)."""
        return self.pool(self.encode(x), count)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.parts[0] + self.parts[1])

    def pool(self, h: np.ndarray, count: np.ndarray):
        _, _, wv, wu, wa, wc, bc = self.parts
        first = np.cumsum(count) - count
        v, u = np.tanh(h @ wv), _sigmoid(h @ wu)
        raw = (v * u) @ wa
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        bag = np.add.reduceat(a[:, None] * h, first, axis=0)
        return _sigmoid(bag @ wc + bc), (h, v, u, a, bag, first)

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss."""
        _, _, wv, wu, wa, wc, _ = self.parts
        p, (h, v, u, a, bag, first) = self.forward(x, count)
        error = (p - y) / len(y)
        dbag = np.repeat(error[:, None] * wc, count, axis=0)
        da = (dbag * h).sum(axis=1)
        draw = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        dgate = draw[:, None] * wa
        dv, du = dgate * u * (1 - v * v), dgate * v * u * (1 - u)
        dh = (a[:, None] * dbag + dv @ wv.T + du @ wu.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dv, h.T @ du, (draw[:, None] * v * u).sum(axis=0), bag.T @ error, error.sum(keepdims=True)]

    @classmethod
    def train(cls, bags: list[np.ndarray], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> AttentionMil | None:
        """``bags``: features of each document's passages. None if there is nothing to learn from."""
        if not len(y):
            return None
        model, rng = cls.new(seed), np.random.default_rng(seed)
        first, second = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(y), BATCH)
            grads = model.gradients(np.concatenate([bags[i] for i in pick]), np.array([len(bags[i]) for i in pick]), y[pick].astype(np.float32))
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for p, d, m, v in zip(model.parts, grads, first, second):  # Adam
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        counts, n = passages(*utf8(batch.column("text")))
        whole = [c.astype(np.uint16).tobytes() for c in np.split(counts, np.cumsum(n)[:-1])]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "counts": pa.array(whole, pa.binary())})


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 5, steps: int = STEPS) -> AttentionMil | None:
    """Learns from ``SAMPLE`` labelled documents whose crc32(id) mod ``fold`` is not 0, each read as a whole; fewer where the first of them, by hash, pass ``SAMPLE_BYTES`` together.

    Of labels that disagree on an id the larger counts; null labels and labels without a document count for nothing; of rows that repeat an
    id and text one counts, other texts of an id count too; without any there is no model.
    """
    small_batches(docs.sparkSession)
    mine = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("quality")).filter((remainder(F.col("doc_id"), fold) != 0) & F.col("quality").isNotNull())
    mine = mine.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size")).join(mine, "doc_id").distinct()
    order = (F.xxhash64("doc_id", F.lit(2)), "doc_id", "h")
    before = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1))  # SAMPLE rows of numbers, the texts are not moved
    picked = keys.orderBy(*order).limit(SAMPLE).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") <= SAMPLE_BYTES)
    picked = materialise(picked.select("doc_id", "h", "quality"))  # so it may be broadcast
    found = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).drop("h")
    rows = found.mapInArrow(_bags, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, quality int, counts binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["counts"]))
    bags = [features(np.frombuffer(r["counts"], np.uint16).reshape(-1, FEATURES).astype(np.int64)) for r in rows]
    return AttentionMil.train(bags, np.array([r["quality"] for r in rows]), steps)


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if model.value is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                data, off = utf8(batch.column("text"))
                if len(off) == 2 and len(data) > PIECE:  # a long text is encoded piece by piece
                    cut = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                    h = np.concatenate([model.value.encode(features(passages(c, np.array([0, len(c)]))[0])) for c in cut])
                    p = model.value.pool(h, np.array([len(h)]))[0]
                else:
                    counts, n = passages(data, off)
                    p = model.value.forward(features(counts), n)[0]
                p = np.clip(p.astype(np.float64), 0, 1)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= THRESHOLD).astype(np.int32))})

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: AttentionMil | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out (crc32 of the id mod 5 is 0), score, predicted (1 from a score of 0.3).

    Every passage of a text counts. Null and empty texts are one passage without bytes; equal texts have equal scores; without a labelled
    document all scores are 0.5; an empty table gives no rows.
    """
    model = model or train_quality(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 20 KB
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (remainder(F.col(id_col), 5) == 0).alias("held_out"))
    return mine.mapInArrow(tidy(_scores(shared)), f"doc_id {mine.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
