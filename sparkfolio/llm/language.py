"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads every byte of a text, blanks included, in both directions and gives each a distribution over languages; a document's probabilities
are their mean. Texts of any length are read in windows of ``WINDOW`` bytes. In each, the network starts ``CONTEXT`` bytes before the first label
it gives, and ends as many after the last, across words and blanks; beyond the ends of a text stands an edge symbol. It is
trained in numpy by backpropagation through time, on the whole documents of a bounded sample.

Arrays are laid out with windows along the last axis, where numpy is fastest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, materialise, slices, small_batches, tidy, utf8

UNDETERMINED = "und"
#: The sample: documents of each language, in the order of a hash of their ids, and documents over all languages (beyond eight languages, each has fewer),
#: until together they pass SAMPLE_BYTES. Each is learned from as a whole, however long it is.
SAMPLE_DOCS, SAMPLE_ROWS, SAMPLE_BYTES = 250, 2000, 1 << 25
#: Bytes of the windows that a sampled text is cut into; documents count alike, whatever their length.
LEARNED = 96
HIDDEN, STEPS, BATCH, RATE = 12, 240, 192, 0.02
#: Bytes labelled in a window, and bytes read before and after them.
WINDOW, CONTEXT = 224, 32
#: Windows that run side by side.
WINDOWS = 512
#: Symbol that stands before and after a text.
EDGE = 256
LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the second axis, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


@dataclass
class BiGru:
    """Weights: by direction the input table (symbol to gates), recurrent weights and candidate bias; then the output layer. Gates: update, reset, candidate."""

    table: list[np.ndarray]
    recur: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, classes: int, hidden: int = HIDDEN, seed: int = 7) -> BiGru:
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            [make(3 * hidden, EDGE + 1, scale=0.3) for _ in "fb"],
            [make(3 * hidden, hidden, scale=hidden**-0.5) for _ in "fb"],
            [np.zeros(hidden, np.float32) for _ in "fb"],
            make(classes, 2 * hidden, scale=0.1),
            np.zeros(classes, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, *self.bias, self.out, self.out_bias]

    def states(self, x: np.ndarray, k: int, begin: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
        """Hidden states (place, hidden, window) of direction k over symbols x (place, window). ``begin``: how many places of each window the backward direction reads."""
        if trace is None:
            return self._states(x, k, begin)
        hidden, n = self.recur[k].shape[1], x.shape[1]
        h = np.zeros((hidden, n), self.out.dtype)
        out = np.empty((len(x), hidden, n), self.out.dtype)
        bias = self.bias[k][:, None]
        for t in range(len(x)) if k == 0 else reversed(range(len(x))):
            given = np.take(self.table[k], x[t], axis=1, mode="clip")  # symbols are in the table; numpy is slower where it checks
            back = self.recur[k] @ h
            gates = _sigmoid(given[: 2 * hidden] + back[: 2 * hidden])
            z, r = gates[:hidden], gates[hidden:]
            inner = back[2 * hidden :] + bias
            c = np.tanh(given[2 * hidden :] + r * inner)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            trace.append((t, h, z, r, inner, c))
            h = new
        return out

    def _states(self, x: np.ndarray, k: int, begin: np.ndarray | None) -> np.ndarray:
        """``states`` without a trace, laid out as (gate, window, unit), so that a symbol's weights are looked up as rows. With t = tanh(a / 2) a gate is
        (1 + t) / 2; the halves are in the weights. One more unit is always 1 and carries the bias: its update gate is 1, its candidate 0."""
        hidden, n, dtype = self.recur[k].shape[1], x.shape[1], self.out.dtype
        table, recur = np.zeros((3, self.table[k].shape[1], hidden + 1), dtype), np.zeros((3, hidden + 1, hidden + 1), dtype)
        table[..., :hidden] = self.table[k].reshape(3, hidden, -1).transpose(0, 2, 1)
        table[:2] *= 0.5
        table[0, :, hidden] = 100
        recur[:, :hidden, :hidden] = self.recur[k].reshape(3, hidden, hidden).transpose(0, 2, 1)
        recur[2, hidden, :hidden] = self.bias[k]
        recur *= 0.5
        out = np.empty((len(x), n, hidden + 1), dtype)
        h = np.zeros((n, hidden + 1), dtype)
        h[:, hidden] = 1
        least = len(x) if begin is None else int(begin.min())
        given, back = np.empty((2, 3, n, hidden + 1), dtype)
        (z, r, inner), gates, c = back, back[:2], given[2]
        for t in range(len(x)) if k == 0 else reversed(range(len(x))):
            np.take(table, x[t], axis=1, out=given, mode="clip")  # symbols are in the table; numpy is slower where it checks
            np.matmul(h, recur, out=back)
            gates += given[:2]
            np.tanh(gates, out=gates)
            c += inner
            r *= inner
            c += r
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= 0.5
            z *= new
            new += c
            new += z
            if t >= least:
                new[:, :hidden] *= (t < begin)[:, None]
            h = new
        return out[..., :hidden].transpose(0, 2, 1)

    def logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(place, language, window)"""
        hidden = forward.shape[1]
        out = self.out[:, :hidden] @ forward
        out += self.out[:, hidden:] @ backward
        out += self.out_bias[:, None]
        return out

    def probabilities(self, x: np.ndarray, context: int = 0, begin: np.ndarray | None = None) -> np.ndarray:
        """(place, language, window) of the symbols that have ``context`` symbols before and after them."""
        rows = len(x) - 2 * context
        forward = self.states(x[: rows + context], 0)[context:]
        backward = self.states(x[context:], 1, begin)[:rows]
        return _softmax(self.logits(forward, backward))

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of the mean cross entropy; target is (language, window) and holds for each symbol, weight (place, window)."""
        hidden = self.recur[0].shape[1]
        traces: list[list] = [[], []]
        states = np.concatenate([self.states(x, k, trace=traces[k]) for k in (0, 1)], axis=1)
        p = _softmax(self.logits(states[:, :hidden], states[:, hidden:]))
        total = weight.sum()
        loss = float(-(weight * (np.log(p + 1e-9) * target).sum(axis=1)).sum() / total)
        error = (p - target) * (weight / total)[:, None]
        grad_out = (error @ states.transpose(0, 2, 1)).sum(axis=0)
        down = self.out.T @ error
        order = np.argsort(x, axis=None, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(x.ravel()[order]) != 0))
        symbols = x.ravel()[order[first]]
        tables, recurs, biases = [], [], []
        for k in (0, 1):
            table, recur, bias = np.zeros_like(self.table[k]), np.zeros_like(self.recur[k]), np.zeros_like(self.bias[k])
            gates = np.empty((len(x), 3 * hidden, x.shape[1]), x.dtype if x.dtype.kind == "f" else self.out.dtype)
            dh = np.zeros((hidden, x.shape[1]), self.out.dtype)
            for t, before, z, r, inner, c in reversed(traces[k]):  # through time, against the reading direction
                dh = dh + down[t, k * hidden : (k + 1) * hidden]
                dc = dh * (1 - z) * (1 - c * c)
                dinner = dc * r
                gates[t, :hidden] = dh * (before - c) * z * (1 - z)
                gates[t, hidden : 2 * hidden] = dc * inner * r * (1 - r)
                gates[t, 2 * hidden :] = dc
                back = np.concatenate([gates[t, : 2 * hidden], dinner])
                recur += back @ before.T
                bias += dinner.sum(axis=1)
                dh = dh * z + self.recur[k].T @ back
            flat = gates.transpose(1, 0, 2).reshape(3 * hidden, -1)
            table[:, symbols] = np.add.reduceat(flat[:, order], first, axis=1)
            tables.append(table)
            recurs.append(recur)
            biases.append(bias)
        return loss, [*tables, *recurs, *biases, grad_out, error.sum(axis=(0, 2))]


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the windows of all texts, the longest first."""
    size = np.diff(offsets)
    count = -(-size // window)
    text = np.repeat(np.arange(len(size)), count)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * window
    length = np.minimum(window, offsets[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    return text[order], start[order], length[order]


@dataclass
class LanguageModel:
    languages: list[str]
    net: BiGru | None

    @classmethod
    def train(cls, texts: list[tuple[bytes, int]], languages: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 7) -> LanguageModel:
        """``texts``: bytes and number of the language of each. They are cut into windows, a part of which is shown with edges where a text would begin or end."""
        if not texts:
            return cls(languages, None)
        net, rng = BiGru.new(len(languages), hidden, seed), np.random.default_rng(seed)
        size = np.array([len(b) for b, _ in texts])
        count = -(-size // LEARNED)
        text = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        whole, start = np.frombuffer(b"".join(b for b, _ in texts), np.uint8), np.cumsum(size) - size
        last = np.minimum(size[text] - place * LEARNED, LEARNED)
        x = np.full((LEARNED, len(text)), EDGE, np.int16)
        for t in range(LEARNED):
            has = last > t
            x[t, has] = whole[(start[text] + place * LEARNED + t)[has]]
        target = np.eye(len(languages), dtype=np.float32)[:, np.array([k for _, k in texts])[text]]
        odds = 1 / count[text] / (np.bincount([k for _, k in texts], minlength=len(languages)) @ target)  # languages alike, and so the documents of each
        odds /= odds.sum()
        first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
        for step in range(1, steps + 1):
            pick = rng.choice(len(text), BATCH, p=odds)
            some = x[:, pick].astype(np.int64)
            cut = rng.integers(0, CONTEXT + 1, BATCH) * (rng.random(BATCH) < 0.25)
            some[np.arange(LEARNED)[:, None] < cut] = EDGE
            _, grads = net.gradients(some, target[:, pick], (some != EDGE).astype(np.float32))
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for p, d, m, v in zip(net.parts(), grads, first, second):  # Adam
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(languages, net)

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): the distributions of all bytes of each text, added up."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        text, start, length = windows_of(data, offsets)
        side = max(16, min(WINDOWS, WINDOWS * 8 // len(self.languages)))
        padded = np.concatenate([data, np.zeros(1, np.uint8)]).astype(np.int64)
        for a in range(0, len(text), side):
            at, begin, n = text[a : a + side], start[a : a + side], length[a : a + side]
            rows = int(n.max())
            place = begin + np.arange(-CONTEXT, rows + CONTEXT)[:, None]
            inside = (place >= offsets[at]) & (place < offsets[at + 1])
            x = np.where(inside, padded[np.clip(place, 0, len(data))], EDGE)
            p = self.net.probabilities(x, CONTEXT, n + CONTEXT)
            least = int(n.min())
            p[least:] *= (np.arange(least, rows)[:, None] < n)[:, None]
            np.add.at(out, at, p.sum(axis=0, dtype=np.float64).T)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of UTF-8 texts."""
        size = np.diff(offsets)
        names, scores = [UNDETERMINED] * len(size), [0.0] * len(size)
        if self.net is None or not len(data):
            return names, scores
        letter = np.append(0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122)))
        some = letter[offsets[1:]] > letter[offsets[:-1]]
        for i in np.flatnonzero(~some & (size > 0)):
            some[i] = LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace")) is not None
        for i, p in enumerate(self.sums(data, offsets)):
            if some[i]:
                best = int(p.argmax())
                names[i], scores[i] = self.languages[best], min(1.0, round(float(p[best] / size[i]), 6))
        return names, scores


def remainder(col: Column, by: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(by))


def train_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 4, out: int = 2, steps: int = STEPS) -> LanguageModel:
    """Learns from ``SAMPLE_DOCS`` documents of each language, by hash, whose crc32(id) mod ``fold`` is not ``out``.

    They come to the driver as whole texts, ``SAMPLE_BYTES`` and one text together at most. Rows with a null text, id or language are left out but for
    a null id, which is as any other; rows that repeat an id and text count once; without rows there is no network, and all is undetermined.
    """
    small_batches(docs.sparkSession)
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    mine = mine.filter((remainder(F.col("doc_id"), fold) != out) & F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("h", F.xxhash64("text"))
    order = (F.xxhash64("doc_id", F.lit(1)), "doc_id", "h")
    keys = mine.select("lang", "doc_id", "h", F.octet_length("text").cast("long").alias("size")).distinct()
    keys = keys.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("n") <= SAMPLE_DOCS).orderBy("n", "lang").limit(SAMPLE_ROWS)
    before = F.sum("size").over(W.orderBy("n", "lang").rowsBetween(W.unboundedPreceding, -1))  # SAMPLE_ROWS rows of numbers, the texts are not moved
    picked = materialise(keys.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") <= SAMPLE_BYTES).select("lang", F.col("doc_id").alias("picked_id"), "h", "n"))
    found = mine.join(F.broadcast(picked), (mine["lang"] == picked["lang"]) & mine["doc_id"].eqNullSafe(F.col("picked_id")) & (mine["h"] == picked["h"])).select(picked["lang"], "n", "text")
    rows = sorted(found.dropDuplicates(["lang", "n"]).collect(), key=lambda r: (r["n"], r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    return LanguageModel.train([(r["text"].encode(), languages.index(r["lang"])) for r in rows], languages, steps)


#: Bytes of text that are read at a time.
SLICE = 1 << 18


def _predictions(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            names, scores = model.value.predict(*utf8(batch.column("text")))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is all if there is no labelled row to learn from. Equal texts have
    equal values; every byte of a text of any length counts; rows that repeat an id are rows of their own; an empty table gives no rows.
    """
    model = model or train_language(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 100 KB
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (remainder(F.col(id_col), 4) == 2).alias("held_out"))
    return mine.mapInArrow(tidy(_predictions(shared)), f"doc_id {mine.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def language_column(docs: DataFrame, text_col: str = "text", **names) -> Column:
    """The struct (lang, score) of each text, by a model learned from ``docs``, to filter rows as they stand. Null and empty texts, ties and empty tables as in ``identify_language``."""
    shared = docs.sparkSession.sparkContext.broadcast(train_language(docs, text_col=text_col, **names))

    @F.arrow_udf("lang string, score double")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for part in parts:
                batch = pa.record_batch({"text": part})
                found: tuple[list, list] = ([], [])
                for piece in slices([batch], "text", SLICE):
                    for all_, some in zip(found, shared.value.predict(*utf8(piece.column("text")))):
                        all_ += some
                yield pa.StructArray.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], ["lang", "score"])
        finally:  # workers are used again by later stages
            give_back()

    return predict(F.col(text_col).cast("string"))
