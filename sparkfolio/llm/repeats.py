"""Repeated passages by the common-prefix interval tree of an enhanced suffix array.

``maximal_repeats`` is the method on strings in memory: suffix array, common prefixes, a stack
scan over them for the intervals of the tree, and the diversity of left extensions to keep just
maximal repeats, each with all its occurrences.

``remove_repeats`` is the same over a corpus. A string of ``least`` bytes holds an anchor, the
least hash of its 32-byte windows, which depends on nothing but the string; so equal strings
have equal anchors at equal places. Texts are cut into segments that share an anchor, only
anchors that occur again are followed, and the suffixes that start at equal anchors meet in one
bucket, where a sparse suffix array of them is scanned. Segments that are the same wherever their anchor occurs are repeats as a whole. A bucket over the
bounds is resolved by counts of its whole strings, which no task has to hold together.

``repeated_passages`` counts passages of over 50 words that stand in another document as well, however many bytes they have: by the same anchors, over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, BitFilter, id_text, is_empty, materialise, release, slices, tidy, utf8
from .rolling import gram_hashes, mixed, word_bounds, word_hashes

LEAST = 400
GRAM = 32
#: Words of a passage, and of the stretches of it that anchors are chosen among.
PASSAGE, PASSAGE_GRAM = 51, 8
#: Different segments of a bucket that one task scans; the strings of a larger one are counted instead. A segment has under twice LEAST bytes.
BUCKET_SEGMENTS = 8192
#: A bucket whose intervals hold so many members for each segment is counted as well.
BUCKET_DEPTH = 200
_LOW = 22  # bits for a position in a slice of texts


# The tree, in memory


def suffix_array(data: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n = len(data)
    rank, width = np.unique(data, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n and rank[order].max(initial=0) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.append(0, pair[order][1:] != pair[order][:-1]))
        width *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> list[int]:
    """Length that suffix order[i] shares with order[i - 1], at place i; 0 at place 0 (Kasai's scan)."""
    n, raw = len(data), data.tolist()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    out, k, before = [0] * n, 0, order.tolist()
    for i, r in enumerate(rank.tolist()):
        if r:
            j = before[r - 1]
            while i + k < n and j + k < n and raw[i + k] == raw[j + k]:
                k += 1
            out[r] = k
            k = max(0, k - 1)
        else:
            k = 0
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of the tree with depth over 0, children first."""
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp[1:], -1], 1):
        first = i - 1
        while stack and depth < stack[-1][0]:
            top, first = stack.pop()
            if top > 0:
                yield top, first, i - 1
        if depth > 0 and (not stack or depth > stack[-1][0]):
            stack.append((depth, first))


def maximal_repeats(strings: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences) of every string of ``least`` bytes or more that occurs again and that no byte to the left or the right extends at all its
    occurrences. Occurrences are (string, start), all of them, in order."""
    parts, owner, start = [], [], []
    for i, s in enumerate(strings):
        parts.append(np.append(np.frombuffer(s, np.uint8).astype(np.int64) + len(strings), i))  # an end that differs from every other
        owner += [i] * (len(s) + 1)
        start += range(len(s) + 1)
    data = np.concatenate(parts) if parts else np.empty(0, np.int64)
    order = suffix_array(data)
    left = [int(data[p - 1]) if p else -1 for p in order.tolist()]
    out = []
    for depth, a, b in intervals(common_prefixes(data, order)) if len(data) else ():
        if depth >= least:
            before = left[a : b + 1]
            if before[0] < len(strings) or any(x != before[0] for x in before):  # starts of strings count as different
                out.append((depth, sorted((owner[p], start[p]) for p in order[a : b + 1].tolist())))
    return sorted(out)


# Segments


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash among h[p:p + width], the leftmost of equals, for each p."""
    n = len(h)
    if width == 1:
        return np.arange(n)
    if n >= 1 << _LOW:  # a very long text: hashes and places apart
        half = n // 2
        return np.concatenate([_leftmost_least(h[: half + width - 1], width), half + _leftmost_least(h[half:], width)])
    low = np.uint64((1 << _LOW) - 1)
    v = np.full(-(-n // width) * width, ~np.uint64(0), np.uint64)
    v[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    block = v.reshape(-1, width)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(block, axis=1).ravel()
    return (np.minimum(ahead[: n - width + 1], behind[width - 1 : n]) & low).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM, piece: int = 2 * SLICE):
    """Cuts each text's windows of ``least`` bytes into runs with the same anchor.

    Returns text, begin, count, anchor (place in data) and key of each run; its bytes are
    data[begin:begin + count - 1 + least]. A single text of over ``piece`` bytes goes piece by piece, which may cut a run in two.
    """
    if len(offsets) != 2 or len(data) <= piece:
        return _segments(gram_hashes(data, gram), offsets, least, gram)
    parts = []
    for at in range(0, len(data) - least + 1, piece):
        part = data[at : at + piece + least - 1]
        text, begin, count, anchor, key = _segments(gram_hashes(part, gram), np.array([0, len(part)]), least, gram)
        parts.append((text, begin + at, count, anchor + at, key))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _segments(h: np.ndarray, offsets: np.ndarray, least: int, gram: int):
    """``h``: the hash of each stretch of ``gram`` bytes (or words)."""
    size = np.diff(offsets)
    n = np.maximum(0, size - least + 1)
    if not n.sum():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    text = np.repeat(np.arange(len(size)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][text]
    anchor = _leftmost_least(h, least - gram + 1)[place]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    return text[first], place[first], np.diff(np.append(first, len(place))), anchor[first], h[anchor[first]]


def _content(whole: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(begin.tolist(), end.tolist())]), ">i8").reshape(-1, 2).astype(np.int64)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _keys(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            *_, key = segments(*utf8(batch.column("text")), least, gram)
            yield pa.record_batch({"key": _long(key)})

    return run


def _segment_rows(least: int, gram: int, again: BitFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = utf8(batch.column("text"))
            text, begin, count, anchor, key = segments(data, off, least, gram)
            keep = np.flatnonzero(again.has(key))
            text, begin, count, anchor, key = (x[keep] for x in (text, begin, count, anchor, key))
            content = _content(data.tobytes(), begin, begin + count - 1 + least)
            row = pa.array(text)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(row),
                    "th": batch.column("th").take(row),
                    "begin": _long(begin - off[text]),
                    "size": _long(count - 1 + least),
                    "anchor": _long(anchor - begin),
                    "key": _long(key),
                    "c1": _long(content[:, 0]),
                    "c2": _long(content[:, 1]),
                }
            )

    return run


# Buckets


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def anchored_repeats(bucket: list[tuple[bytes, int, int]], least: int, depth_limit: int = BUCKET_DEPTH) -> list[list[tuple[int, int]]] | None:
    """For each (segment, place of its anchor, copies) of a bucket, the spans that repeats of ``least`` bytes cover; None if the tree is too deep.

    The suffixes at the anchors make a sparse suffix array. An interval of depth r holds the
    segments that agree on r bytes from the anchor on; within it, how far two of them agree to the left is where their left extensions
    become diverse, so l bytes to the left and r to the right are a maximal repeat.
    """
    out: list[list[tuple[int, int]]] = [[(0, len(s))] if copies > 1 else [] for s, _, copies in bucket]
    if len(bucket) < 2:
        return out
    right = [s[a:] for s, a, _ in bucket]
    left = [s[:a][::-1] for s, a, _ in bucket]
    order = sorted(range(len(bucket)), key=right.__getitem__)
    lcp = [0] + [_shared(right[i], right[j]) for i, j in zip(order, order[1:])]
    by_left = {i: r for r, i in enumerate(sorted(range(len(bucket)), key=left.__getitem__))}
    most, work = max(map(len, left)), 0
    for depth, a, b in intervals(lcp):
        if depth + most < least:
            continue
        work += b - a + 1
        if work > depth_limit * len(bucket) + 10000:
            return None
        members = sorted(order[a : b + 1], key=by_left.__getitem__)
        for i, j in zip(members, members[1:]):
            back = _shared(left[i], left[j])
            if back + depth >= least:
                for k in (i, j):
                    at = bucket[k][1]
                    out[k].append((at - back, at + depth))
    return [merged(x) if len(x) > 1 else x for x in out]


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SEGMENT = "key long, c1 long, c2 long, copies long, anchor long, bytes binary"


def _buckets(least: int, depth_limit: int):
    """Rows come ordered by key. A bucket is scanned, or handed on as it is with ``hot`` set if its tree is too deep."""

    def solved(rows: list[tuple]) -> list[tuple]:
        spans = anchored_repeats([(r[5], r[4], r[3]) for r in rows], least, depth_limit)
        if spans is None:
            return [(*r, [], True) for r in rows]
        return [(*r[:5], None, [{"a": a, "b": b} for a, b in s], False) for r, s in zip(rows, spans) if s]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ("key", "c1", "c2", "copies", "anchor")
        columns = {k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(names)}
        return pa.record_batch(columns | {"bytes": pa.array([r[5] for r in rows], pa.binary()), "spans": pa.array([r[6] for r in rows], _SPANS), "hot": pa.array([r[7] for r in rows], pa.bool_())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and row[0] != held[0][0]:
                    out += solved(held)
                    held = []
                held.append(row)
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
        out += solved(held) if held else []
        if out:
            yield batch_of(out)

    return run


def _windows(least: int):
    """Every string of ``least`` bytes of the segments, as a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in enumerate(batch.column("bytes").to_pylist()):
                begin = np.arange(len(whole) - least + 1)
                content = _content(whole, begin, begin + least)
                one = {k: pa.array(np.full(len(begin), batch.column(k)[i].as_py())) for k in ("key", "c1", "c2", "copies")}
                yield pa.record_batch(one | {"at": pa.array(begin), "w1": _long(content[:, 0]), "w2": _long(content[:, 1])})

    return run


_WINDOW = "key long, c1 long, c2 long, copies long, at long, w1 long, w2 long"


def _counted(windows: DataFrame, least: int) -> DataFrame:
    """key, c1, c2, spans of segments by counts of all their strings."""
    windows = materialise(windows)
    again = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).filter("n > 1")
    span = F.struct(F.col("at").alias("a"), (F.col("at") + least).alias("b"))
    return windows.join(materialise(again), ["w1", "w2"]).groupBy("key", "c1", "c2").agg(F.collect_list(span).alias("spans"))


def _repeated(found: DataFrame, least: int, depth_limit: int) -> DataFrame:
    """key, c1, c2, spans of the segments (one row each, with ``copies``) that a repeat touches."""
    rows = found.select("key", "c1", "c2", "copies", "anchor", "bytes").repartition("key").sortWithinPartitions("key")
    out = materialise(rows.mapInArrow(tidy(_buckets(least, depth_limit)), _SEGMENT + ", spans array<struct<a: long, b: long>>, hot boolean"))
    done, deep = out.filter("not hot").select("key", "c1", "c2", "spans"), out.filter("hot")
    return done if is_empty(deep) else done.unionByName(_counted(deep.mapInArrow(_windows(least), _WINDOW), least))


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = text.encode()
            rows += [(w["key"], w["c1"], w["c2"], w["copies"], w["anchor"], raw[w["begin"] : w["begin"] + w["size"]]) for w in wanted]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "c1", "c2", "copies", "anchor", "bytes"])


# Passages of words


def word_segments(data: np.ndarray, offsets: np.ndarray, words: int, gram: int):
    """Word hashes of texts, and the runs of their windows of ``words`` words with the same anchor: text, begin (in words), count, key."""
    start, end, owner = word_bounds(data, offsets)
    word = word_hashes(data, start, end)
    cut = np.searchsorted(owner, np.arange(len(offsets)))
    text, begin, count, _, key = _segments(_rolled(word, gram), cut, words, gram)
    return word, cut, text, begin, count, key


def _rolled(word: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row."""
    out = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for j in range(n):
        out *= np.uint64(_STEP)
        out += word[j : j + len(out)]
    return mixed(out)


_STEP = 0x9E3779B97F4A7C15


def _passage_keys(words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            *_, text, _, _, key = word_segments(*utf8(batch.column("text")), words, gram)
            yield pa.record_batch({"key": _long(key), "row": batch.column("row").take(pa.array(text))})

    return run


def _passage_windows(words: int, gram: int, again: BitFilter):
    """A row for each run of windows whose anchor occurs again: where it begins, its windows' hashes, and a hash of them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            word, cut, text, begin, count, key = word_segments(*utf8(batch.column("text")), words, gram)
            keep = np.flatnonzero(again.has(key))
            text, begin, count = text[keep], begin[keep], count[keep]
            ends = np.append(0, np.cumsum(count))
            windows = _rolled(word, words)[np.repeat(begin - ends[:-1], count) + np.arange(ends[-1])] if len(keep) else np.empty(0, np.uint64)
            raw, row = windows.tobytes(), pa.array(text)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(row),
                    "th": batch.column("th").take(row),
                    "row": batch.column("row").take(row),
                    "at": _long(begin - cut[text]),
                    "content": pa.array([xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.uint64()).view(pa.int64()),
                    "windows": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _long(windows)),
                }
            )

    return run


def repeated_passages(docs: DataFrame, words: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """doc_id, th, n_passages for each document (doc_id, th, text) that holds passages of ``words`` words or more which stand in another one too.

    Words stand between ASCII white space and count as they are; overlapping passages count as one. Rows equal in id and text are one document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "th", "text", F.xxhash64("doc_id", "th").alias("row")).filter(F.octet_length("text") >= 2 * words - 1)
    two = lambda rows, key: rows.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select(key)
    keys = docs.select("text", "row").mapInArrow(tidy(_passage_keys(words, gram)), "key long, row long").select("key", F.col("row").alias("lo"), F.col("row").alias("hi"))
    again = materialise(two(keys, "key"))
    runs = docs.mapInArrow(tidy(_passage_windows(words, gram, BitFilter(again, hashed=True))), f"doc_id {kind}, th long, row long, at long, content long, windows array<long>")
    runs = materialise(runs)
    one = materialise(runs.groupBy("content").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.any_value("windows").alias("windows")))
    # Runs that stand in several documents as they are need no look at their windows; those of one document meet the windows that several have.
    common = materialise(two(one.select("lo", "hi", F.explode("windows").alias("w")), "w"))
    alone = one.filter("lo = hi").select("content", F.posexplode("windows").alias("i", "w")).filter(BitFilter(common, hashed=True).column(F.col("w")))
    alone = alone.join(common, "w").groupBy("content").agg(F.collect_list(F.col("i").cast("long")).alias("places"))
    whole = one.filter("lo <> hi").select("content", F.expr("sequence(0L, size(windows) - 1L)").alias("places"))
    places = materialise(whole.unionByName(alone))
    found = runs.select("doc_id", "th", "at", "content").join(places, "content").select("doc_id", "th", F.expr("transform(places, i -> i + at)").alias("places"))
    starts = found.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("s"))
    count = F.expr(f"if(size(s) = 1, 1, 1 + size(filter(sequence(1, size(s) - 1), i -> s[i] - s[i - 1] > {words})))").cast("long")
    out = materialise(starts.select("doc_id", "th", count.alias("n_passages")))
    release(again, runs, one, common, places)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        size, gone, runs, sha, kept_text = [], [], [], [], []
        listed = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
        for text, spans in zip(batch.column("text").to_pylist(), listed):
            raw = (text or "").encode()
            spans = merged([(s["a"], s["b"]) for s in spans or ()])
            keep, at = [], 0
            for a, b in spans:
                keep.append(raw[at:a])
                at = b
            keep = b"".join([*keep, raw[at:]])
            size.append(len(raw))
            gone.append(len(raw) - len(keep))
            runs.append(len(spans))
            sha.append(hashlib.sha256(keep).hexdigest())
            kept_text.append(keep)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(size, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "n_spans": pa.array(runs, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
                "n_passages": batch.column("n_passages") if "n_passages" in batch.schema.names else pa.array(np.zeros(len(size), np.int64)),
            }
            | ({"kept": pa.array(kept_text, pa.binary())} if "with_kept" in batch.schema.names else {})
        )


def _untouched(bits: BitFilter):
    """The same for the texts that surely have no spans, in the worker that finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digests(b.filter(pa.array(~bits.has_slot(b.column("slot").to_numpy()))) for b in batches)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, with_kept: bool = False, most: int = BUCKET_SEGMENTS, depth_limit: int = BUCKET_DEPTH, words: int = PASSAGE) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages (and ``kept``, the remaining bytes).

    A byte goes if a string of ``least`` bytes that also starts elsewhere, in the same text or another, covers it; strings are judged on the
    input. Null text counts as empty; texts under ``least`` bytes stay whole; rows that repeat an id are rows of their own, and
    equal texts remove each other; an empty table gives no rows. Strings count as equal with equal 128-bit hashes or by
    comparison. ``n_passages`` counts passages of ``words`` words or more that also stand in another document; they may have fewer bytes, and nothing is
    removed for them.
    """
    docs = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    long_docs = docs.filter(F.octet_length("text") >= least)

    passages = repeated_passages(docs, words)

    keys = long_docs.select("text").mapInArrow(tidy(_keys(least, gram)), "key long")
    again = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    found = materialise(long_docs.mapInArrow(tidy(_segment_rows(least, gram, BitFilter(again, hashed=True))), f"doc_id {kind}, th long, begin long, size long, anchor long, key long, c1 long, c2 long"))
    place = F.struct("doc_id", "th", "begin", "size", "anchor")
    distinct = materialise(found.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at")))
    per_key = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum("copies").alias("total")).filter("total > 1")
    distinct = materialise(distinct.join(materialise(per_key), "key"))  # AQE can split a frequent key between two tables

    # Segments that are the same wherever their anchor occurs are repeats as a whole.
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("at.size").alias("b")))
    plain = distinct.filter("different = 1").select("key", "c1", "c2", whole.alias("spans"))
    wanted = F.struct("key", "c1", "c2", "copies", "at.anchor", "at.begin", "at.size").alias("w")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])

    def holders_of(which: DataFrame) -> DataFrame:
        """Texts with the segments to be cut out of them, each segment from one text that holds it."""
        lists = materialise(which.select("at.*", wanted).groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted")))
        holders = long_docs.filter(BitFilter(lists.select("th")).column(F.col("th"))).dropDuplicates(["doc_id", "th"])
        return holders.join(lists, same(holders, lists)).select("text", "wanted")

    small = holders_of(distinct.filter(f"different between 2 and {most}")).mapInArrow(tidy(_cut_segments), _SEGMENT)
    spans = plain.unionByName(_repeated(small, least, depth_limit))
    large = distinct.filter(f"different > greatest(1, {most})")
    if not is_empty(large):  # no task holds such a bucket together
        windows = holders_of(large).mapInArrow(lambda batches: _windows(least)(_cut_segments(batches)), _WINDOW)
        spans = spans.unionByName(_counted(windows, least))

    # Back to the texts.
    spans = found.join(spans, ["key", "c1", "c2"]).select("doc_id", "th", F.expr("transform(spans, s -> struct(s.a + begin as a, s.b + begin as b))").alias("spans"))
    spans = spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # rows equal in id and text have the same spans, which count once
    passages = passages.withColumnsRenamed({"doc_id": "in_id", "th": "in_th"})
    same_row = F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("th") == F.col("in_th"))
    spans = spans.join(passages, same_row, "full").select(F.coalesce("doc_id", "in_id").alias("spans_id"), F.coalesce("th", "in_th").alias("spans_th"), "spans", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"))
    spans = materialise(spans)
    bits = BitFilter(spans.select("spans_th"))
    if with_kept:
        docs = docs.withColumn("with_kept", F.lit(True))
    touched = docs.filter(bits.column(F.col("th"))).join(spans, F.col("doc_id").eqNullSafe(F.col("spans_id")) & (F.col("th") == F.col("spans_th")), "left").drop("spans_id", "spans_th", "th")
    touched = touched.na.fill(0, ["n_passages"])
    other = docs.withColumn("slot", bits.slot_of(F.col("th"))).drop("th")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"
    if with_kept:
        schema += ", kept binary"
    return touched.mapInArrow(tidy(_digests), schema).unionByName(other.mapInArrow(tidy(_untouched(bits)), schema))
