"""Near copies by the exact Jaccard similarity of their word shingles.

Candidates come from two places. Fingerprints (SimHash of the set of shingles) that share a Golay key bring most of a large group together. The rest
come from shingles: order all shingles alike everywhere, and two sets of similarity ``LEAST`` share one of their first n - ceil(LEAST * n) + 1. Any order is
right; here shingles that are frequent among those first ones go last, as counts over all documents tell, so that buckets stay small. All pairs
are verified on their whole sets, after bounds by histograms. First come neighbours in the buckets and linked fingerprints, whose links contract groups of
copies, then the pairs of a bucket that are not yet connected. Texts that share hundreds of first shingles meet in as many buckets; each row knows the last
few of its keys before the bucket's, and a pair that has one of them in common has met there before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BitFilter, is_empty, kept_rows, materialise, release, slices, small_batches, text_hash, tidy, utf8
from .components import components
from .rolling import majority_bits, shingle_sets
from .simhash import near_links

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Shingles that come first in more documents than this go last in the order.
OFTEN = 32
#: Buckets of the histograms, of a byte each, that bound the overlap of two sets before the sets move: first coarse, then fine.
COARSE, FINE = 128, 1024
#: A bucket beyond this is dealt out: by hash for neighbours, in pairs of blocks for pairs.
BUCKET = 4096
#: Keys before a bucket's own that a row of it knows, and rows made with them at a time.
RECENT, MADE = 8, 1 << 16
#: Bytes of text that are hashed at a time.
SLICE = 1 << 18


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(*utf8(batch.column("text")), shingle)


def first_shingles(hashes: np.ndarray, count: np.ndarray, last: np.ndarray | None, least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set (sorted hashes, set by set) that similar sets must share one of, and how many of each set. ``last`` marks those that go last."""
    owner = np.repeat(np.arange(len(count)), count)
    if last is not None and last.any():
        hashes = hashes[np.lexsort((hashes, last, owner))]
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
    most = count - -(-least[0] * count // least[1]) + 1
    return hashes[place < most[owner]], np.minimum(most, count)


def _first(batch: pa.RecordBatch, shingle: int, least: tuple[int, int], often: BitFilter | None):
    hashes, count = _sets(batch, shingle)
    keys, size = first_shingles(hashes, count, None if often is None else often.has(hashes), least)
    return hashes, count, keys, size


def _often(docs: DataFrame, shingle: int, least: tuple[int, int]) -> BitFilter | None:
    """Shingles that come first in more than OFTEN documents, in an order by hash alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield pa.record_batch({"key": pa.array(_first(batch, shingle, least, None)[2].view(np.int64))})

    found = materialise(docs.select("text").mapInArrow(tidy(rows), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OFTEN).select("key"))
    return None if is_empty(found) else BitFilter(found, hashed=True)


def histograms(hashes: np.ndarray, count: np.ndarray, bins: int) -> list[bytes]:
    """How many hashes of each set fall into each bin, 255 meaning that many or more."""
    owner = np.repeat(np.arange(len(count)), count)
    out = np.bincount(owner * bins + (hashes & np.uint64(bins - 1)).astype(np.int64), minlength=len(count) * bins)
    return [b.tobytes() for b in np.minimum(out, 255).astype(np.uint8).reshape(-1, bins)]


def _documents(docs: DataFrame, shingle: int, least: tuple[int, int], often: BitFilter | None) -> DataFrame:
    """node, doc_id, th, n, usual, fp, keys, coarse, fine: of each document the size, fingerprint and histograms of its set, how many of a million of its
    shingles are frequent ones, and its first shingles. Rows equal in id and text are one node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            hashes, count, keys, size = _first(batch, shingle, least, often)
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(keys.view(np.int64)))
            fp = majority_bits(hashes, count)
            ends = np.append(0, np.cumsum(np.zeros(len(hashes), np.int64) if often is None else often.has(hashes)))
            stops = np.cumsum(count)
            usual = (ends[stops] - ends[stops - count]) * 1_000_000 // count
            out = {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n": pa.array(count.astype(np.int64)), "usual": pa.array(usual), "fp": pa.array(fp.view(np.int64)), "keys": listed}
            yield pa.record_batch(out | {k: pa.array(histograms(hashes, count, bins), pa.binary()) for k, bins in (("coarse", COARSE), ("fine", FINE))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = materialise(docs.mapInArrow(tidy(rows), f"doc_id {kind}, th long, n long, usual long, fp long, keys array<long>, coarse binary, fine binary").withColumn("node", F.monotonically_increasing_id()))
    again = materialise(out.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("one")).filter("rows > 1").select(F.col("doc_id").alias("again_id"), F.col("th").alias("again_th"), "one"))
    if is_empty(again):
        return out
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("th") == F.col("again_th")) & (F.col("node") != F.col("one"))
    return materialise(out.join(again, same, "left_anti"))


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _by_fingerprint(nodes: DataFrame, limit: int) -> DataFrame:
    """Pairs (u, v) of nodes with equal fingerprints or linked ones: each with the least node of its fingerprint, and those with each other."""
    one = materialise(nodes.groupBy("fp").agg(F.min("node").alias("one")))
    equal = nodes.select("node", "fp").join(one, "fp").filter("node <> one").select(*_pair("one", "node"))
    links = materialise(near_links(one, limit))
    ends = links.join(one.select(F.col("fp").alias("u"), F.col("one").alias("a")), "u").join(one.select(F.col("fp").alias("v"), F.col("one").alias("b")), "v")
    return equal.unionByName(ends.select(*_pair("a", "b")))


def _shared_rows(nodes: DataFrame) -> DataFrame:
    """key, n, usual, node, rows: first shingles that ``rows`` > 1 documents have, row by row."""
    counts = materialise(nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    some = BitFilter(counts.select("key"), hashed=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("keys").value_lengths().to_numpy()
            keys = batch.column("keys").flatten().to_numpy()
            go = some.has(keys)
            owner = pa.array(np.repeat(np.arange(len(size)), size)[go])
            yield pa.record_batch({"key": pa.array(keys[go])} | {k: batch.column(k).take(owner) for k in ("n", "usual", "node")})

    found = materialise(nodes.select("keys", "n", "usual", "node").mapInArrow(tidy(rows), "key long, n long, usual long, node long"))
    out = materialise(found.join(counts, "key"))  # AQE can split a frequent key between two written tables
    release(counts, found)
    return out


def _neighbours(shared: DataFrame, least: tuple[int, int], limit: int, turn: int) -> DataFrame:
    """Pairs (u, v) of nodes that may be similar by their sizes: those next to each other in a bucket, by size, and each with the bucket's most usual
    one, which is near the text that the others were copied from. A large bucket is dealt by a hash that each turn has its own of."""
    part = F.when(F.col("rows") <= limit, 0).otherwise(F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("rows") / limit)))
    bucket = Window.partitionBy("key", "part")
    by_size, centre = bucket.orderBy("n", "node"), F.max(F.struct("usual", "node", "n")).over(bucket)
    beside = shared.withColumn("part", part).withColumns({"before": F.struct(F.lag("node").over(by_size).alias("node"), F.lag("n").over(by_size).alias("n")), "centre": F.struct(centre["node"].alias("node"), centre["n"].alias("n"))})
    pairs = beside.select("node", "n", F.explode(F.array("before", "centre")).alias("other")).filter("node <> other.node")
    fits = F.least("n", "other.n") * least[1] >= F.greatest("n", "other.n") * least[0]
    return pairs.filter(fits).select(*_pair("node", "other.node"))


def met_before(recent_a: np.ndarray, many_a: np.ndarray, recent_b: np.ndarray, many_b: np.ndarray) -> np.ndarray:
    """Whether pairs of rows have one of their ``recent`` keys (row, RECENT) in common, of which the first ``many`` count."""
    one, two = (np.arange(recent_a.shape[1]) < many[:, None] for many in (many_a, many_b))
    return ((recent_a[:, :, None] == recent_b[:, None]) & one[:, :, None] & two[:, None]).any(axis=(1, 2))


def _recent_rows(some: BitFilter):
    """A maker of rows (key, node, many, recent): keys of each node that may be in ``some``, with the up to RECENT ones that stand before them in the list."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("keys").value_lengths().to_numpy()
            keys = batch.column("keys").flatten().to_numpy()
            go = some.has(keys)
            owner, keys = np.repeat(np.arange(len(size)), size)[go], keys[go]
            place = np.arange(len(keys)) - np.searchsorted(owner, owner)
            for a in range(0, len(keys), MADE):
                at = np.arange(a, min(a + MADE, len(keys)))
                recent = keys[np.maximum(at[:, None] - np.arange(1, RECENT + 1), 0)]
                held = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * (8 * RECENT)), pa.py_buffer(recent)])
                yield pa.record_batch({"key": pa.array(keys[at]), "node": batch.column("node").take(pa.array(owner[at])), "many": pa.array(np.minimum(place[at], RECENT)), "recent": held})

    return rows


def _bucket_pairs(least: tuple[int, int]):
    """A maker of the pairs (u, v) within each bucket that may be similar by their sizes and coarse histograms, have no root in common and have not met in a
    bucket before. Rows come ordered by key. Those of one ``side`` meet elsewhere, but for side -1."""

    def solve(n: np.ndarray, node: np.ndarray, root: np.ndarray, side: np.ndarray, many: np.ndarray, recent: np.ndarray, coarse: np.ndarray, block: int = 256) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(n), block):
            mine = slice(a, a + block)
            one, two = n[mine, None], n[None]
            fits = (root[mine, None] != root) & (least[1] * np.minimum(one, two) >= least[0] * np.maximum(one, two)) & (node[mine, None] < node)
            fits &= (side[mine, None] != side) | (side < 0)
            i, j = np.nonzero(fits)
            i += a
            for at in range(0, len(i), 8192):
                x, y = i[at : at + 8192], j[at : at + 8192]
                new = ~met_before(recent[x], many[x], recent[y], many[y])
                x, y = x[new], y[new]
                keep = bounded(coarse[x], coarse[y], n[x] + n[y], least)
                if keep.any():
                    yield pa.record_batch({"u": pa.array(node[x[keep]]), "v": pa.array(node[y[keep]])})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []  # the bucket that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, *columns = (batch.column(c).to_numpy() for c in ("key", "n", "node", "root", "side", "many"))
            columns += [_matrix(batch.column("recent")).view(np.int64), _matrix(batch.column("coarse"))]
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for a, b in zip(bounds[:-1], bounds[1:]):
                if keys[a] != key:
                    if parts:
                        yield from solve(*map(np.concatenate, zip(*parts)))
                    key, parts = int(keys[a]), []
                parts.append([c[a:b] for c in columns])
        if parts:
            yield from solve(*map(np.concatenate, zip(*parts)))

    return rows


def _open_pairs(nodes: DataFrame, shared: DataFrame, roots: DataFrame, least: tuple[int, int], limit: int) -> DataFrame:
    """Pairs (u, v) of nodes that share a first shingle, may be similar by their sizes and coarse histograms and are not connected yet.

    Keys have one order in all lists, so two nodes meet first in the bucket of the first open key of both, where no key before is common: that bucket makes the pair.
    """
    rooted = shared.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    open_keys = materialise(rooted.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "rows"))
    some = BitFilter(open_keys.select("key"), hashed=True)
    found = materialise(nodes.select("node", "keys").mapInArrow(tidy(_recent_rows(some)), "key long, node long, many long, recent binary"))
    last = F.ceil(F.col("rows") / limit) - 1
    dealt = found.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), last + 1)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    key = F.when(last == 0, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")))
    side = F.when(F.col("block") == F.col("with"), F.lit(-1).cast("long")).otherwise(F.col("block"))
    dealt = dealt.select(key.alias("key"), "node", side.alias("side"), "many", "recent")
    rows = nodes.select("node", "n", "coarse").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dealt = dealt.join(rows, "node").select("key", "n", "node", "root", "side", "many", "recent", "coarse")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_bucket_pairs(least)), "u long, v long")


def _matrix(histograms: pa.Array) -> np.ndarray:
    """Rows of histograms of one width."""
    return utf8(histograms)[0].reshape(len(histograms), -1)


def bounded(a: np.ndarray, b: np.ndarray, n: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether pairs of sets may have the least similarity by their histograms; ``n``: the sum of both sizes."""
    both = np.minimum(a, b)
    most = both.sum(axis=1, dtype=np.int64)  # the overlap is no larger, unless a bin is full
    return (most * least[1] >= least[0] * (n - most)) | (both == 255).any(axis=1)


def _likely(nodes: DataFrame, pairs: DataFrame, column: str, least: tuple[int, int]) -> DataFrame:
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = bounded(_matrix(batch.column("a")), _matrix(batch.column("b")), batch.column("n").to_numpy(), least)
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    first = pairs.join(nodes.select(F.col("node").alias("u"), F.col(column).alias("a"), F.col("n").alias("one")), "u")
    both = first.join(nodes.select(F.col("node").alias("v"), F.col(column).alias("b"), F.col("n").alias("two")), "v")
    return materialise(both.select("u", "v", "a", "b", (F.col("one") + F.col("two")).alias("n")).mapInArrow(tidy(bound), "u long, v long"))


def _set_rows(docs: DataFrame, inside: DataFrame, shingle: int) -> DataFrame:
    """node, hashes: the sets of the documents that are ``inside`` (node, in_id, in_th). A task has one Python worker, which looks texts up and hashes them."""
    some = BitFilter(inside.select("in_th"), hashed=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            go = pa.array(some.has(batch.column("th").to_numpy()))
            for part in slices([batch.filter(go)], "text", SLICE):
                hashes, count = _sets(part, shingle)
                cut, whole = np.append(0, np.cumsum(count) * 8).tolist(), hashes.tobytes()
                yield pa.record_batch({"doc_id": part.column("doc_id"), "th": part.column("th"), "hashes": pa.array([whole[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    found = docs.select("doc_id", "text", "th").mapInArrow(tidy(rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, hashes binary")
    return found.join(inside, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("th") == F.col("in_th"))).select("node", "hashes")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: tuple[int, int], bound: bool = False) -> DataFrame:
    """The pairs (u, v) (of which ``bound`` says that they have passed the coarse histograms) whose whole sets have the least similarity. Only texts of documents in pairs that pass both bounds are hashed again and moved."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both * least[1] >= least[0] * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs.filter("u <> v").distinct())
    likely = _likely(nodes, pairs if bound else _likely(nodes, pairs, "coarse", least), "fine", least)
    inside = likely.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    inside = materialise(nodes.select("node", F.col("doc_id").alias("in_id"), F.col("th").alias("in_th")).join(inside, "node"))
    sets = materialise(_set_rows(docs, inside, shingle).dropDuplicates(["node"]))
    first = likely.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    both = first.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v").select("u", "v", "a", "b")
    out = materialise(both.mapInArrow(tidy(check), "u long, v long"))
    release(pairs, likely, inside, sets)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, limit: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, th (``text_hash``), component_id, kept.

    Documents are linked where the Jaccard similarity of their sets of word shingles is ``least`` or more. Fingerprints of the sets that share a Golay key and
    are at three bits or fewer are the first candidates; they bring large groups together, but at a similarity of 0.8 most fingerprints are further apart, so
    the shingles find the rest, and every link is verified on the sets. ``component_id`` is the smallest id reachable, and one row of each component is
    ``kept``: that of the smallest id (nulls last) and text hash. Null texts count as empty; texts without words are alike; rows that repeat an id are rows of
    their own; rows equal in id and text are one document, with equal values. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_hash(text_col).alias("th"))
    nodes = _documents(docs, shingle, least, _often(docs, shingle, least))
    shared = _shared_rows(nodes)
    largest = shared.agg(F.max("rows")).first()[0] or 0
    first = _by_fingerprint(nodes, limit).unionByName(_neighbours(shared, least, limit, 0))
    for turn in range(1, 3 if largest > limit else 1):  # parts of large buckets meet in other parts
        first = first.unionByName(_neighbours(shared, least, limit, turn))
    links = _verified(docs, nodes, first, shingle, least)
    roots = materialise(components(links))
    links = links.unionByName(_verified(docs, nodes, _open_pairs(nodes, shared, roots, least, limit), shingle, least, True))
    release(shared)
    roots = materialise(components(links).join(nodes.select("node", "doc_id", "th"), "node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = materialise(roots.groupBy("root").agg(F.min(order).alias("best")))
    member = roots.join(best, "root").select("node", F.col("best.doc_id").alias("component_id"), (order == F.col("best")).alias("kept"))
    found = nodes.select("node", "doc_id", "th").join(materialise(member), "node", "left")
    alone = F.col("kept").isNull()
    out = found.select("doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("kept", F.lit(True)).alias("kept"))
    rows = docs.select("doc_id", "th")
    out = out.withColumnsRenamed({"doc_id": "node_id", "th": "node_th"})
    return rows.join(out, F.col("doc_id").eqNullSafe(F.col("node_id")) & (F.col("th") == F.col("node_th"))).select("doc_id", "th", "component_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that ``near_copies`` keeps, with all their columns; of rows equal in id and text, one. Null ids and texts as there."""

    return kept_rows(docs, materialise(near_copies(docs, id_col, text_col, **settings)), id_col, text_col)
