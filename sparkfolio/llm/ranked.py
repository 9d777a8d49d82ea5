"""Ranked lexical search over an index whose documents are put in order by recursive graph bisection.

Building: a bounded sample of documents is bisected into groups, every document goes to the group whose terms cost it least, and
tasks collect documents of a group until a part is full. Each part is bisected in turn, down to clusters of some hundred documents, on the graph
of all its documents and terms. A cluster keeps its documents' ids, its terms with their postings, and the best value any of its documents has for a term.

Searching: a cluster's bound for an item is the sum of the weights times those best values. The clusters with the highest bounds are visited first; the tenth best score
found there is what any other cluster's bound must reach to be visited at all. So the result is that of scoring every document.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import id_text, materialise, shuffle_width, slices, tidy, utf8
from .rolling import LOWER, TERM, word_bounds, word_hashes

#: Documents of a cluster at most, and its postings (a document with more is a cluster of its own).
CLUSTER, POSTINGS = 128, 1 << 20
#: Terms, repeats included, after which a part is full.
PART = 2_000_000
#: Documents from which the groups are learned (about), terms of each that count, terms kept for all groups, groups.
SAMPLE, SAMPLE_TERMS, GROUP_TERMS, GROUPS = 2048, 256, 32768, 16
#: Times that documents change sides at most, for each halving.
ROUNDS = 8
#: Clusters that each item visits before the rest is bounded.
FIRST = 4
#: A block of items has so many different terms times items at most (or one item).
BLOCK = 4_000_000
#: Fixed values of the score: per cent of length normalisation, its scale, and the value of a term.
LENGTH_PART, SCALE, TF_SCALE, LENGTH_SCALE = 75, 1_000_000_000, 1000, 8
MOST_VALUE = SCALE // TF_SCALE


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms, and the number of the text each is in."""
    data = LOWER[data]
    start, end, text = word_bounds(data, offsets, TERM)
    return word_hashes(data, start, end), text


def term_counts(terms: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and how often the text has it; texts in order."""
    order = np.lexsort((terms, text))
    terms, text = terms[order], text[order]
    new = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (text[1:] != text[:-1]))[: len(terms)])
    return text[new], terms[new], np.diff(np.append(new, len(terms)))


def bisection_order(doc: np.ndarray, term: np.ndarray, docs: int, least: int, rounds: int = ROUNDS) -> np.ndarray:
    """The documents 0 to ``docs`` - 1 in an order by recursive bisection, where documents that share terms come near each other.

    ``doc`` and ``term`` (numbered from 0) are the edges of the graph. Each range of over ``least`` documents is halved: the gain of
    a document is what its terms' logarithmic gaps would lose if it changed sides, and documents of both sides change places, best gains first, while the two gains together are positive.
    """
    order = np.arange(docs)
    begin, end = np.array([0]), np.array([docs])
    if not len(term):
        return order
    g = np.arange(docs + 3) * np.log2(np.arange(docs + 3) + 1.0)
    while int((end - begin).max()) > least:
        middle = begin + (end - begin + 1) // 2
        node = np.empty(docs, np.int64)
        node[order] = np.repeat(np.arange(len(begin)), end - begin)
        place = np.arange(docs) - np.repeat(begin, end - begin)
        side = np.empty(docs, bool)
        side[order] = place >= np.repeat(middle - begin, end - begin)
        _, key, count = np.unique(node[doc] * (int(term.max()) + 1) + term, return_inverse=True, return_counts=True)
        shared = count[key] > 1  # a term of one document of a range costs the same on either side
        edge, (_, key) = doc[shared], np.unique(key[shared], return_inverse=True)
        count = np.bincount(key)
        right_place = np.repeat(middle, end - middle) + np.arange(int((end - middle).sum())) - np.repeat(np.cumsum(end - middle) - (end - middle), end - middle)
        left_place = right_place - np.repeat(middle - begin, end - middle)
        log_left, log_right = np.log2(np.maximum(1, middle - begin)), np.log2(np.maximum(1, end - middle))
        node_of_key = np.zeros(len(count), np.int64)
        node_of_key[key] = node[edge]
        lean = (log_left - log_right)[node_of_key]
        for _ in range(rounds):
            on_right = side[edge]
            right = np.bincount(key, on_right, len(count)).astype(np.int64)
            left = count - right
            here = g[left] + g[right]
            to_right = lean + g[np.maximum(left - 1, 0)] + g[right + 1] - here
            to_left = g[left + 1] + g[np.maximum(right - 1, 0)] - here - lean
            gain = np.bincount(edge, np.where(on_right, to_left[key], to_right[key]), docs)
            order = np.lexsort((-gain, side, node))
            a, b = order[left_place], order[right_place]
            change = gain[a] + gain[b] > 1e-9
            if not change.any():
                break
            side[a[change]], side[b[change]] = True, False
        order = np.lexsort((side, node))
        begin, end = np.stack([begin, middle], axis=1).ravel(), np.stack([middle, end], axis=1).ravel()
        begin, end = begin[end > begin], end[end > begin]
    return order


def group_weights(doc: np.ndarray, terms: np.ndarray, docs: int, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order of hash, and what each costs a document in each group."""
    vocabulary, term = np.unique(terms, return_inverse=True)
    order = bisection_order(doc, term, docs, max(1, -(-docs // groups)))
    group = np.empty(docs, np.int64)
    group[order] = np.arange(docs) * groups // max(docs, 1)
    df = np.bincount(term, minlength=len(vocabulary))
    often = np.sort(np.argsort(-df, kind="stable")[:GROUP_TERMS])
    often = often[df[often] > 1]
    number = np.full(len(vocabulary), -1)
    number[often] = np.arange(len(often))
    has = number[term] >= 0
    counts = np.bincount(number[term[has]] * groups + group[doc[has]], minlength=len(often) * groups).reshape(-1, groups)
    return vocabulary[often], -np.log2(counts + 1.0).astype(np.float32)


def document_values(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that occurs tf times in a document of ``length`` terms is worth there."""
    if int(length.max(initial=0)) * LENGTH_PART * n_docs < 2**63:
        m = 100 - LENGTH_PART + (LENGTH_PART * length * n_docs) // n_terms
    else:
        m = np.array([100 - LENGTH_PART + (LENGTH_PART * int(x) * n_docs) // n_terms for x in length], np.int64)
    return (SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)


def _counted(fraction: float):
    """Documents with a term and terms of a task, and the sketches of a sample: of each of its documents the SAMPLE_TERMS smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        documents = words = 0
        sketches: list[np.ndarray] = []
        sizes: list[int] = []
        for batch in slices(batches, "text"):
            data, off = utf8(batch.column("text"))
            start, _, text = word_bounds(data, off, TERM)
            size = np.bincount(text, minlength=len(off) - 1)
            documents, words = documents + int((size > 0).sum()), words + len(start)
            for i in np.flatnonzero(rng.random(len(size)) < fraction):
                terms, _ = terms_of(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                sketches.append(np.unique(terms)[:SAMPLE_TERMS].view(np.int64))
                sizes.append(int(size[i]))
        none = [0] * len(sketches)
        columns = {"documents": pa.array([documents, *none], pa.int64()), "terms": pa.array([words, *none], pa.int64()), "size": pa.array([0, *sizes], pa.int64())}
        yield pa.record_batch(columns | {"sketch": pa.array([None, *sketches], pa.list_(pa.int64()))})

    return run


def cheapest_group(terms: np.ndarray, text: np.ndarray, texts: int, vocabulary: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The group whose terms cost each text least."""
    cost = np.zeros((texts, GROUPS))
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        known = vocabulary[at] == terms
        at, text = at[known], text[known]
        if len(at):
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            cost[text[first]] = np.add.reduceat(weights[at], first, axis=0)
    return np.argmin(cost, axis=1)


def _group_column(salts: np.ndarray, shared):
    """A number for the cheapest group of a text and one of the group's ``salts`` in turn, so that no group is one task."""
    first_of = np.cumsum(salts) - salts

    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)]
        for part in slices([pa.record_batch({"text": texts})], "text"):
            out.append(cheapest_group(*terms_of(*utf8(part.column("text"))), part.num_rows, *shared.value))
        group = np.concatenate(out)
        turn = (np.arange(len(group)) + TaskContext.get().partitionId()) % salts[group]
        return pa.array(first_of[group] + turn, pa.int64())

    return F.arrow_udf(run, "long")


def _clusters(id_type: pa.DataType, n_docs: int, n_terms: int):
    def build(part: int, ids: list[pa.Array], lengths: list[np.ndarray], edges: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, length = pa.concat_arrays(ids), np.concatenate(lengths)
        doc, term, tf = (np.concatenate(x) for x in zip(*edges))
        vocabulary, number = np.unique(term, return_inverse=True)
        order = bisection_order(doc, number, len(length), CLUSTER)
        value = document_values(tf, length[doc], n_docs, n_terms)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_place = np.argsort(place[doc], kind="stable")
        doc, number, value = place[doc[by_place]], number[by_place], value[by_place]
        before = np.searchsorted(doc, np.arange(len(order) + 1))
        begin, cluster = 0, 0
        while begin < len(order):
            end = min(begin + CLUSTER, len(order), max(begin + 1, int(np.searchsorted(before, before[begin] + POSTINGS, "right")) - 1))
            a, b = before[begin], before[end]
            by_term = a + np.lexsort((doc[a:b], number[a:b]))
            terms = number[by_term]
            first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
            blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            yield pa.record_batch(
                {
                    "part": pa.array([part], pa.int64()),
                    "cluster": pa.array([cluster], pa.int32()),
                    "ids": pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), ids.take(pa.array(order[begin:end])), pa.list_(pa.field("element", id_type))),
                    "terms": blob(vocabulary[terms[first]], np.uint64),
                    "most": blob(np.maximum.reduceat(value[by_term], first), np.int32),
                    "counts": blob(np.diff(np.append(first, b - a)), np.int32),
                    "places": blob(doc[by_term] - begin, np.uint8),
                    "q": blob(value[by_term], np.int32),
                }
            )
            begin, cluster = end, cluster + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        ids, lengths, edges, docs, words = [], [], [], 0, 0
        for batch in slices(batches, "text"):
            terms, text = terms_of(*utf8(batch.column("text")))
            length = np.bincount(text, minlength=batch.num_rows)
            some = np.flatnonzero(length)  # a document without terms is never found
            number = np.cumsum(length > 0) - 1
            doc, term, tf = term_counts(terms, text)
            ids.append(batch.column("doc_id").take(pa.array(some)).cast(id_type))
            lengths.append(length[some])
            edges.append((number[doc] + docs, term, tf))
            docs, words = docs + len(some), words + len(terms)
            if words >= PART:
                yield from build(part, ids, lengths, edges)
                part, ids, lengths, edges, docs, words = part + 1, [], [], [], 0, 0
        if docs:
            yield from build(part, ids, lengths, edges)

    return run


@dataclass
class Block:
    """Items that are searched together: their different terms, and for each how often an item has it times its weight."""

    ids: list
    vocabulary: np.ndarray
    #: terms x items
    counts: np.ndarray
    weights: np.ndarray | None = None


def _blocks(items: DataFrame) -> Iterator[Block]:
    """Reads the items once, block by block; no more than a block is held."""
    ids, found, different = [], [], set()
    for r in items.toLocalIterator():
        terms, _ = terms_of(*utf8(pa.array([r["text"]], pa.string())))
        if not len(terms):
            continue
        values, counts = np.unique(terms, return_counts=True)
        new = different.union(values.tolist())
        if ids and len(new) * (len(ids) + 1) > BLOCK:
            yield _block(ids, found)
            ids, found, new = [], [], set(values.tolist())
        ids.append(r["item_id"])
        found.append((values, counts))
        different = new
    if ids:
        yield _block(ids, found)


def _block(ids: list, found: list) -> Block:
    vocabulary = np.unique(np.concatenate([v for v, _ in found]))
    counts = np.zeros((len(vocabulary), len(ids)), np.int64)
    for i, (values, n) in enumerate(found):
        counts[np.searchsorted(vocabulary, values), i] = n
    return Block(ids, vocabulary, counts)


def _known(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in a cluster's terms the vocabulary's are, and their numbers in the vocabulary."""
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    number = np.flatnonzero(terms[at] == vocabulary)
    return at[number], number


def _array(batch: pa.RecordBatch, name: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


def _dfs(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.value.vocabulary), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, number = _known(block.value.vocabulary, _array(batch, "terms", i, np.uint64))
                total[number] += _array(batch, "counts", i, np.int32)[at]
        some = np.flatnonzero(total)
        yield pa.record_batch({"number": pa.array(some, pa.int64()), "df": pa.array(total[some])})

    return run


def _bounds_of(batch: pa.RecordBatch, block: Block) -> np.ndarray:
    """clusters x items: no document of the cluster scores more. Whole numbers, held in doubles where they fit."""
    best = np.zeros((batch.num_rows, len(block.vocabulary)), block.weights.dtype)
    for i in range(batch.num_rows):
        at, number = _known(block.vocabulary, _array(batch, "terms", i, np.uint64))
        best[i, number] = _array(batch, "most", i, np.int32)[at]
    return best @ block.weights


def _best_clusters(block, first: int):
    """Of a task's clusters those with the highest bounds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block.value.ids]
        for batch in batches:
            bounds = _bounds_of(batch, block.value)
            keys = list(zip(batch.column("part").to_pylist(), batch.column("cluster").to_pylist()))
            for item in np.flatnonzero(bounds.max(axis=0, initial=0) > 0):
                column = bounds[:, item]
                some = np.argsort(-column, kind="stable")[:first]
                best[item] = heapq.nsmallest(first, best[item] + [(-int(column[i]), *keys[i]) for i in some if column[i] > 0])
        rows = [(item, part, cluster, -bound) for item, found in enumerate(best) for bound, part, cluster in found]
        kinds = {"item": pa.int32(), "part": pa.int64(), "cluster": pa.int32(), "bound": pa.int64()}
        yield pa.record_batch({k: pa.array([r[j] for r in rows], kind) for j, (k, kind) in enumerate(kinds.items())})

    return run


def _scores(batch: pa.RecordBatch, row: int, block: Block, items: np.ndarray, docs: int) -> np.ndarray:
    """items x documents of a cluster."""
    at, number = _known(block.vocabulary, _array(batch, "terms", row, np.uint64))
    counts = _array(batch, "counts", row, np.int32)
    start = np.cumsum(counts) - counts
    n = counts[at]
    postings = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    values = np.zeros((len(number), docs), block.weights.dtype)
    values[np.repeat(np.arange(len(number)), n), _array(batch, "places", row, np.uint8)[postings]] = _array(batch, "q", row, np.int32)[postings]
    return block.weights[np.ix_(number, items)].T @ values


def _visit(block, k: int, least: np.ndarray, only: dict | None, seen: dict, id_type: pa.DataType):
    """The best documents of a task's clusters for each item.

    ``only``: the items that visit a cluster, by its key; else those that have not yet (``seen``) and whose bound reaches ``least`` and the k-th best score of the
    task so far. A bound that equals it is no reason to stop, since the smaller id wins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(block.value.ids)
        best: list[list[tuple]] = [[] for _ in range(items)]
        reach = np.maximum(least, 1)
        visits = 0
        for batch in batches:
            keys = list(zip(batch.column("part").to_pylist(), batch.column("cluster").to_pylist()))
            bounds = None if only is not None else _bounds_of(batch, block.value)
            order = range(batch.num_rows) if bounds is None else np.argsort(-bounds.max(axis=1, initial=0), kind="stable")
            for i in order:
                if only is not None:
                    mine = np.array(only.get(keys[i], []), np.int64)
                else:
                    mine = np.setdiff1d(np.flatnonzero(bounds[i] >= reach), seen.get(keys[i], []))
                if not len(mine):
                    continue
                visits += len(mine)
                ids = batch.column("ids")[i].values
                scores = _scores(batch, i, block.value, mine, len(ids))
                for j in np.flatnonzero((scores >= reach[mine, None]).any(axis=1)):
                    item, names = mine[j], ids
                    some = np.flatnonzero(scores[j] >= reach[item])
                    found = [(-int(scores[j, d]), x is None, x if x is not None else 0) for d, x in zip(some.tolist(), names.take(pa.array(some)).to_pylist())]
                    best[item] = heapq.nsmallest(k, best[item] + found)
                    if len(best[item]) == k:
                        reach[item] = max(reach[item], -best[item][-1][0])
        rows = [(item, None if null else x, -score) for item, found in enumerate(best) for score, null, x in found] + [(-1, None, visits)]
        kinds = {"item": pa.int32(), "doc_id": id_type, "score": pa.int64()}
        yield pa.record_batch({name: pa.array([r[j] for r in rows], kind) for j, (name, kind) in enumerate(kinds.items())})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.filter("item >= 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class LexicalIndex:
    #: part, cluster, ids, terms, most, counts, places, q: a row for each cluster
    clusters: DataFrame
    n_docs: int
    n_terms: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex | None:
        """Indexes every document with a term; None if there is none. Rows that repeat an id are documents of their own."""
        mine = id_text(docs, id_col, text_col)
        spark = mine.sparkSession
        rows = mine.select("doc_id").count()
        counted = materialise(mine.mapInArrow(tidy(_counted(min(1.0, SAMPLE / max(rows, 1)))), "documents long, terms long, size long, sketch array<long>"))
        n_docs, n_terms = counted.agg(F.sum("documents"), F.sum("terms")).first()
        if not n_docs:
            return None
        sample = counted.filter("sketch IS NOT NULL").limit(2 * SAMPLE).collect()
        sketches = [np.array(r["sketch"], np.int64).view(np.uint64) for r in sample]
        doc, terms = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches]), np.concatenate([*sketches, np.empty(0, np.uint64)])
        model = group_weights(doc, terms, len(sketches))
        tasks = max(-(-2 * n_terms // PART), shuffle_width(spark))
        share = np.bincount(cheapest_group(terms, doc, len(sketches), *model), [r["size"] for r in sample], GROUPS)
        salts = np.maximum(1, np.ceil(tasks * share / max(share.sum(), 1))).astype(np.int64)
        group = _group_column(salts, spark.sparkContext.broadcast(model))  # GROUP_TERMS x GROUPS numbers at most
        dealt = mine.withColumn("part", group(F.col("text"))).repartition(int(tasks), "part").drop("part")
        id_type = mine.schema["doc_id"].dataType.simpleString()
        schema = f"part long, cluster int, ids array<{id_type}>, terms binary, most binary, counts binary, places binary, q binary"
        return cls(materialise(dealt.mapInArrow(tidy(_clusters(_arrow_type(mine), n_docs, n_terms)), schema)), n_docs, n_terms)

    def search(self, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """item_id, rank, doc_id, score of the ``k`` best documents for each row of ``items``, equal scores by the smaller id (null last)."""
        items = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
        schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {self.clusters.schema['ids'].dataType.elementType.simpleString()}, score long"
        found = [self._search(block, k, schema) for block in _blocks(items)]
        spark = items.sparkSession
        return spark.read.schema(schema).parquet(*[f._written_at for f in found]) if found else spark.createDataFrame([], schema)

    def _search(self, block: Block, k: int, schema: str) -> DataFrame:
        spark = self.clusters.sparkSession
        id_type = _arrow_type(self.clusters.select(F.explode("ids").alias("doc_id")))
        shared = spark.sparkContext.broadcast(block)
        counts = {r["number"]: r["df"] for r in self.clusters.select("terms", "counts").mapInArrow(_dfs(shared), "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).collect()}
        weight = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * counts[t] + 1))) if t in counts else 0 for t in range(len(block.vocabulary))], np.int64)
        weights = block.counts * weight[:, None]
        exact = weights.sum(axis=0).max(initial=0) * MOST_VALUE < 2**53  # then sums of products are whole numbers in doubles
        block = Block(block.ids, block.vocabulary, block.counts[:, :0], weights.astype(np.float64) if exact else weights)
        shared = spark.sparkContext.broadcast(block)  # BLOCK numbers at most, or one item
        none = np.zeros(len(block.ids), np.int64)

        bounds = self.clusters.select("part", "cluster", "terms", "most").mapInArrow(_best_clusters(shared, FIRST), "item int, part long, cluster int, bound long")
        by_bound = W.partitionBy("item").orderBy(F.desc("bound"), "part", "cluster")
        first: dict[tuple, list[int]] = {}
        for r in bounds.withColumn("n", F.row_number().over(by_bound)).filter(F.col("n") <= FIRST).collect():  # FIRST an item
            first.setdefault((r["part"], r["cluster"]), []).append(r["item"])
        out = f"item int, doc_id {self.clusters.schema['ids'].dataType.elementType.simpleString()}, score long"
        wanted = spark.createDataFrame([Row(part=p, cluster=c) for p, c in first], "part long, cluster int")
        some = self.clusters.join(F.broadcast(wanted), ["part", "cluster"], "left_semi")
        best = materialise(some.mapInArrow(_visit(shared, k, none, first, {}, id_type), out))

        reached = {r["item"]: r["least"] for r in _top(best, k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect()}
        least = np.array([reached.get(i, 0) for i in range(len(block.ids))], np.int64)
        rest = materialise(self.clusters.mapInArrow(_visit(shared, k, least, None, first, id_type), out))
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item int, {schema.split(',')[0]}")
        top = _top(best.unionByName(rest), k).join(F.broadcast(names), "item")
        done = materialise(top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        done._visits = (best, rest)
        return done


def _arrow_type(ids: DataFrame) -> pa.DataType:
    return to_arrow_type(ids.schema["doc_id"].dataType)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` highest-scoring documents of each item with a score above 0, equal scores by ascending doc_id (null last).

    Null and empty texts have no terms: such documents are never found, such items have no rows. Rows that repeat a doc_id are documents of their own, rows that repeat an item_id are items of
    their own; an empty table on either side gives no rows. Terms are equal by 64-bit hashes. Items are read in blocks, each against the whole index.
    """
    index = LexicalIndex.build(docs, id_col, text_col)
    if index is None:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long")
    return index.search(items, k)
