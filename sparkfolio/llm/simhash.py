"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint of 64 bits has four blocks of 16. Of two fingerprints that differ in three bits at most, some
block is equal, and of the other 48 bits one half of 24 differs in one bit at most. The perfect
binary Golay code (23, 12, 7) turns such halves into keys: a half gives the indices of the codewords
nearest to it and to all its neighbours at one bit, 1 to 6 of them, and halves at one bit share one. Block and
index together are the join key; each candidate pair is verified on all 64 bits.

``near_copies`` takes such links as candidates only and compares the sets of word shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, is_empty, materialise, shuffle_width, slices, texts, tidy
from .components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Generator of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
#: Shingles of a long text that are counted at a time.
BLOCK = 200_000
#: A bucket beyond this is split by further bits; what is still beyond it is dealt out in pairs of blocks.
BUCKET = 4096
#: Nodes that a task remembers to leave out links it has already implied.
FOREST = 500_000


class Golay:
    """Nearest codewords of 23-bit words, by syndrome."""

    def __init__(self):
        one = np.zeros((3, 256), np.uint16)
        for k in range(3):
            for b in range(256):
                one[k, b] = self._remainder(b << 8 * k)
        self._one = one
        bits = [1 << i for i in range(23)]
        errors = [0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits for c in bits if a < b < c)]
        self._error = np.zeros(2048, np.uint32)
        for e in errors:  # 2048 patterns, each with a syndrome of its own: the code is perfect
            self._error[self._remainder(e)] = e

    @staticmethod
    def _remainder(x: int) -> int:
        while x >= 2048:
            x ^= GENERATOR << x.bit_length() - 12
        return x

    def decode(self, words: np.ndarray) -> np.ndarray:
        """12-bit indices of the nearest codewords."""
        one = self._one
        syndrome = one[0, words & 255] ^ one[1, words >> 8 & 255] ^ one[2, words >> 16]
        return (words ^ self._error[syndrome]) >> 11

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and index of each key: codewords nearest to a word and to its neighbours at one bit."""
        near = np.append(0, 1 << np.arange(23)).astype(np.uint32)
        index = np.sort(self.decode(words[:, None] ^ near), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        return np.nonzero(first)[0], index[first]


def fuzzy_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Row and key (31 bits) of each key of the fingerprints."""
    rows, keys = [], []
    for block in range(4):
        shift = np.uint64(16 * block)
        exact = (fp >> shift & np.uint64(0xFFFF)).astype(np.int64)
        low = fp & ((np.uint64(1) << shift) - np.uint64(1))
        rest = low | fp >> np.uint64(16) >> shift << shift
        for half in range(2):
            word = (rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.uint32)
            row, index = golay.keys(word)
            rows.append(row)
            keys.append((block * 2 + half) << 28 | exact[row] << 12 | index.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _bits(hashes: list[int]) -> np.ndarray:
    """(hashes, 64), lowest bit first."""
    return np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: words between ASCII white space, A-Z lower-cased, and every shingle counted as often as it occurs."""
    digest, hashes, count, long = xxhash.xxh64_intdigest, [], [], {}
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        n = len(words)
        joined = b" ".join(words)
        if n > shingle:
            end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            begin, end = np.append(0, end[: n - shingle]), end[shingle - 1 :] - 1
            if len(begin) > BLOCK:  # a long text adds up block by block
                ones = np.zeros(64, np.int64)
                for at in range(0, len(begin), BLOCK):
                    some = [digest(joined[a:b], SEED) for a, b in zip(begin[at : at + BLOCK].tolist(), end[at : at + BLOCK].tolist())]
                    ones += _bits(some).sum(axis=0, dtype=np.int64)
                long[i] = ones * 2 > len(begin)
                count.append(0)
                continue
            hashes += [digest(joined[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist())]
            count.append(n - shingle + 1)
        elif n:
            hashes.append(digest(joined, SEED))
            count.append(1)
        else:
            count.append(0)
    out, n = np.zeros(len(texts), np.uint64), np.array(count)
    some = np.flatnonzero(n)
    if len(some):
        ones = np.add.reduceat(_bits(hashes), (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    for i, bits in long.items():
        out[i] = np.packbits(bits, bitorder="little").view(np.uint64)[0]
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        fp = fingerprints(texts(batch.column("text")))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))})


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            row, key = fuzzy_keys(part.column("fp").to_numpy().view(np.uint64), golay)
            yield pa.record_batch({"key": pa.array(key), "fp": part.column("fp").take(pa.array(row))})


def further_keys(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the four parts that a large bucket's fingerprints fall into again.

    Fingerprints of a bucket that are linked differ in three bits at most in the other half, so one of its four stretches of six bits is equal.
    """
    which = (key >> 28).astype(np.uint64)
    shift = (which >> np.uint64(1)) * np.uint64(16)
    low = fp & ((np.uint64(1) << shift) - np.uint64(1))
    rest = low | fp >> np.uint64(16) >> shift << shift
    other = rest >> np.uint64(24) * (np.uint64(1) - (which & np.uint64(1)))
    keys = [key << 8 | i << 6 | (other >> np.uint64(6 * i) & np.uint64(63)).astype(np.int64) for i in range(4)]
    return np.tile(np.arange(len(key)), 4), np.concatenate(keys)


def _further_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, key = further_keys(batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64))
        yield pa.record_batch({"key": pa.array(key), "fp": batch.column("fp").take(pa.array(row))})


def group_stars(fp: np.ndarray, distance: int = DISTANCE, block: int = 512) -> np.ndarray:
    """Place of the first member of each one's component within a group, found in blocks without listing pairs."""
    label = np.arange(len(fp))
    while True:
        least = label.copy()
        for a in range(0, len(fp), block):
            near = np.bitwise_count(fp[a : a + block, None] ^ fp) <= distance
            least[a : a + block] = np.where(near, label, len(fp)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


class _Forest:
    """Drops links between nodes that earlier links of this task already connect."""

    def __init__(self):
        self._up: dict[int, int] = {}

    def _root(self, x: int) -> int:
        up = self._up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joins(self, a: int, b: int) -> bool:
        if len(self._up) > FOREST:
            self._up.clear()
        a, b = self._root(a), self._root(b)
        if a != b:
            self._up[max(a, b)] = min(a, b)
        return a != b


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by key. Gives the links that connect each bucket's components, and that no earlier link of the task implies."""
    forest, links = _Forest(), []
    key, fps = None, []  # the bucket that may go on in the next batch

    def solve(node: np.ndarray) -> None:
        fp = node.view(np.uint64)
        if len(fp) == 2:
            if int(np.bitwise_count(fp[0] ^ fp[1])) > DISTANCE:
                return
            label = (0, 0)
        else:
            label = group_stars(fp)
        for i, j in enumerate(label):
            if i != j and forest.joins(a := int(node[i]), b := int(node[j])):
                links.append((a, b))

    def close() -> None:
        if sum(map(len, fps)) > 1:
            solve(np.concatenate(fps))

    def found() -> pa.RecordBatch:
        pair = np.array(links, np.int64).reshape(-1, 2)
        links.clear()
        return pa.record_batch({"u": pa.array(pair[:, 0]), "v": pa.array(pair[:, 1])})

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fp = (batch.column(k).to_numpy() for k in ("key", "fp"))
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        size, last = np.diff(bounds), len(bounds) - 2
        for i in sorted({0, last, *np.flatnonzero(size > 1).tolist()}):
            a, b = bounds[i], bounds[i + 1]
            if i not in (0, last):
                solve(fp[a:b])
                continue
            if keys[a] != key:
                close()
                key, fps = int(keys[a]), []
            fps.append(fp[a:b])
        if links:
            yield found()
    close()
    if links:
        yield found()


def near_links(prints: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` that connect all that differ in at most three bits, directly or through others.

    Buckets of over ``limit`` rows are known by their counts before rows move. Such a bucket is split by the bits its key does not use, and what
    is still too large is dealt into blocks by hash, each pair of blocks being work of its own; no task holds the bucket together.
    """
    prints = prints.select("fp").repartition(shuffle_width(prints.sparkSession), "fp")
    keys = prints.mapInArrow(_key_rows, "key long, fp long")
    often = lambda rows: materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit))
    linked = lambda rows: rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_bucket_links), "u long, v long")
    large = often(keys)
    if is_empty(large):
        return linked(keys)
    out = linked(keys.join(large, "key", "left_anti"))
    parts = materialise(keys.join(large, "key").select("key", "fp").mapInArrow(_further_rows, "key long, fp long"))
    large = often(parts)
    last = F.ceil(F.col("n") / limit) - 1
    rows = parts.join(large, "key").withColumn("block", F.pmod(F.xxhash64("fp"), last + 1)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pair = F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))
    return out.unionByName(linked(parts.join(large, "key", "left_anti"))).unionByName(linked(rows.select(pair.alias("key"), "fp")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at three or fewer differing bits are linked, and ``component_id`` is the smallest id
    reachable. Null and empty texts have fingerprint zero, linked like any other; a text of fewer than three words is one
    shingle. Ids are integers; rows that repeat an id are rows of their own; a row with a null id gets the component of its
    fingerprint, null if no id is in it. An empty table gives no rows. Equal fingerprints are one node, so copies
    cost nothing in the search.
    """
    docs = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    fp = materialise(docs.mapInArrow(tidy(_fingerprint_rows), "doc_id long, fp long"))
    nodes = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialise(components(near_links(nodes, limit)).withColumnRenamed("node", "fp").join(nodes, "fp"))
    least = materialise(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    member = materialise(roots.join(least, "root").select("fp", "component_id"))  # two written tables, so that a giant component's partition can be split
    found = materialise(nodes.join(member, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fp.join(found, "fp", "left").select("doc_id", hexed.alias("fingerprint"), "component_id")
