"""Hybrid search of many queries at once: one scan of the chunks and one of the elements answer them all.

In each task a batch of rows meets all queries: vectors in a matrix product, words through a map from lexemes to queries. A task keeps the best
rows of each branch (a wording of a query, by vector or by words) and hands on those alone; what is shuffled grows with queries, branches and tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import lexical, vectors
from ..functions.batches import SLICE, slices, tidy
from ..functions.positions import RANK_DIGITS, Lexemes, Words

#: Branches of a query: two wordings by vector, then two by words, each over chunks and elements.
WORDINGS, KINDS = 2, 2


@dataclass
class Asked:
    """A block of queries. A branch is numbered by query, wording and whether it goes by words."""

    queries: int = 0
    #: query, wording, vector
    by_vector: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    #: query, wording, lexemes by number
    by_words: list[tuple[int, int, list[int]]] = field(default_factory=list)
    lexemes: dict[str, int] = field(default_factory=dict)
    #: query: ids of the documents that it is limited to
    documents: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, query: str, short: str, embed: Callable[[str], list | None], exact: bool, documents=None) -> None:
        q, self.queries = self.queries, self.queries + 1
        if documents is not None:
            self.documents[q] = np.array(documents, np.int64)
        for n, wording in enumerate([query] + ([short] if short != query and len(short) > 2 else [])):
            vector = embed(wording)
            if vector is not None:
                self.by_vector.append((q, n, np.array(vector, np.float64)))
        for n, wording in enumerate([query] + ([short] if short != query else [])):
            found = lexical.query_lexemes(wording, stemmed=not exact)
            if found:
                self.by_words.append((q, n, [self.lexemes.setdefault(x, len(self.lexemes)) for x in found]))


class Best:
    """The ``k`` best rows of each branch so far, by key, then id, with a value beside the key. Rows are numbers into a pool of kept rows."""

    def __init__(self, branches: int, k: int):
        self.key, self.id = np.full((branches, k), np.inf), np.full((branches, k), np.iinfo(np.int64).max)
        self.row, self.value, self.k = np.full((branches, k), -1), np.zeros((branches, k)), k

    def offer(self, branch: int, key: np.ndarray, ids: np.ndarray, rows: np.ndarray, value: np.ndarray | None = None) -> None:
        some = key <= self.key[branch, -1]
        if not some.any():
            return
        value = key if value is None else value
        key, ids, rows, value = (np.concatenate([old[branch], new[some]]) for old, new in ((self.key, key), (self.id, ids), (self.row, rows), (self.value, value)))
        order = np.lexsort((ids, key))[: self.k]
        self.key[branch], self.id[branch], self.row[branch], self.value[branch] = key[order], ids[order], rows[order], value[order]

    def live(self) -> np.ndarray:
        return np.unique(self.row[self.row >= 0])


def distances(x: np.ndarray, q: np.ndarray, rough: np.ndarray, most: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may be among the k nearest to q and no farther than ``most``, with exact distances. ``rough``: squares of distances by a matrix product, which rounds."""
    if len(rough) > k:
        most = min(most, np.sqrt(max(0.0, np.partition(rough, k - 1)[k - 1])))
    size = 1e-9 * (1 + (q * q).sum() + float(np.abs(rough).max(initial=0)))
    rows = np.flatnonzero(rough <= most * most + size) if np.isfinite(most) else np.arange(len(rough))
    return rows, np.sqrt(((x[rows] - q) ** 2).sum(axis=1))


def _offer_nearest(best: Best, asked: Asked, batch: pa.RecordBatch, ids: np.ndarray, may: Callable, first: int) -> None:
    column = batch.column("embedding")
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for size in {len(v) for _, _, v in asked.by_vector}:
        rows = np.flatnonzero(length == size)
        if not len(rows):
            continue
        x = np.asarray(column.take(pa.array(rows)).flatten(), np.float64).reshape(-1, size)
        mine = [(i, q, v) for i, (q, _, v) in enumerate(asked.by_vector) if len(v) == size]
        asked_for = np.array([v for _, _, v in mine])
        rough = (asked_for**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * asked_for @ x.T
        for (i, q, v), near in zip(mine, rough):
            fits = may(q, rows)
            at = np.arange(len(rows)) if fits is None else np.flatnonzero(fits)
            if len(at):
                some, d = distances(x[at], v, near[at], best.key[i, -1], best.k)
                best.offer(i, d, ids[rows[at[some]]], first + rows[at[some]])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose texts have yet to become position vectors come in slices."""
    for batch in batches:
        yield from [batch] if pa.types.is_list(batch.column("worded").type) else slices([batch], "worded", SLICE)


def _answers(asked, k: int, exact: bool, kept: list[str], types: dict[str, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Asked = asked.value
        near, worded = Best(len(a.by_vector), k), Best(len(a.by_words), k)
        names = list(a.lexemes)
        pool = None
        for batch in _small(batches):
            if not batch.num_rows:
                continue
            ids, documents = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "document_id"))
            may = lambda q, rows: None if q not in a.documents else np.isin(documents[rows], a.documents[q])  # noqa: B023, E731
            first = 0 if pool is None else pool.num_rows
            _offer_nearest(near, a, batch, ids, may, first)
            if a.by_words:
                worded_by = batch.column("worded")
                found = Words(worded_by, names) if exact else Lexemes(worded_by if pa.types.is_list(worded_by.type) else lexical.vectors_of(worded_by), names)
                for i, (q, _, codes) in enumerate(a.by_words):
                    if all(len(found.of[c][0]) for c in codes):
                        rows, rank = found.match(codes)
                        fits = may(q, rows)
                        rows, rank = (rows, rank) if fits is None else (rows[fits], rank[fits])
                        worded.offer(i, -np.round(rank, RANK_DIGITS), ids[rows], first + rows, rank)
            mine = pa.table([batch.column(c) for c in kept], kept)
            pool = mine if pool is None else pa.concat_tables([pool, mine])
            live = np.union1d(near.live(), worded.live())
            pool = pool.take(pa.array(live)).combine_chunks()
            for b in (near, worded):
                b.row = np.where(b.row >= 0, np.searchsorted(live, b.row), -1)
        if pool is None:
            return
        out = []
        for b, of, by_words in ((near, a.by_vector, 0), (worded, a.by_words, 1)):
            branch, place = np.nonzero(b.row >= 0)
            query, wording = (np.array([x[j] for x in of], np.int32)[branch] for j in (0, 1))
            key = b.key[branch, place]
            rows = pool.take(pa.array(b.row[branch, place])).to_batches()
            if rows:
                value = b.value[branch, place]
                score = np.maximum(0.0, 1 - 2 * value) if by_words else value
                columns = {"q": pa.array(query), "branch": pa.array(by_words * WORDINGS + wording, pa.int32()), "key": pa.array(key), "score": pa.array(score)}
                out.append(pa.RecordBatch.from_arrays([*columns.values(), *[pa.chunked_array([r.column(c) for r in rows]).combine_chunks().cast(types[c]) for c in kept]], [*columns, *kept]))
        yield from out

    return run


def answers(kinds: list[DataFrame], asked: Asked, limit: int, max_distance: float, kept: list[str], exact: bool = False) -> DataFrame:
    """q, rank, ``kept``, score, first_seen: for each query the best rows of its branches, fused.

    ``kinds``: rows of chunks and of elements with id, document_id, embedding, content, ``kept`` and, but for ``exact``, tsv: position vectors, or texts that the same task turns into them. A row counts by its best score over all
    branches, up to ``max_distance``; equal scores stay in the order in which the rows first came up, by branch, then by rank in it.
    """
    spark = kinds[0].sparkSession
    shared = spark.sparkContext.broadcast(asked)  # a block of queries
    carried = [c for c in kept if c != "score"]
    found = None
    for kind, rows in enumerate(kinds):
        worded = lexical.exact_words(F.col("content")) if exact else F.col("tsv")
        rows = rows.select(*carried, F.col("embedding"), worded.alias("worded"))
        schema = "q int, branch int, key double, score double, " + ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
        types = {c: to_arrow_type(rows.schema[c].dataType) for c in carried}
        one = rows.mapInArrow(tidy(_answers(shared, limit, exact, carried, types)), schema).withColumn("branch", F.col("branch") * KINDS + kind)
        found = one if found is None else found.unionByName(one)
    # Branches in order: wordings by vector over each kind, then wordings by words.
    place = F.row_number().over(W.partitionBy("q", "branch").orderBy("key", "id"))
    found = found.withColumn("place", place).where(F.col("place") <= limit).withColumn("seen", F.col("branch") * 1_000_000 + F.col("place"))
    row = F.struct("score", *carried)
    best = found.groupBy("q", F.col("source_type").alias("of"), F.col("id").alias("of_id")).agg(F.min_by(row, F.struct("score", "seen")).alias("r"), F.min("seen").alias("first_seen"))
    best = best.select("q", *[F.col(f"r.{c}") for c in kept], "first_seen").where(F.col("score") <= max_distance)
    return best.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.round("score", RANK_DIGITS), "first_seen"))).where(F.col("rank") <= limit)


def search_batch(corpus, queries: DataFrame, embed_all: Callable[[list[str]], list], limit: int = 10, include_chunks: bool = True, include_elements: bool = True, max_distance: float | None = None, exact_words: bool = False, block: int | None = None) -> DataFrame:
    """query_id, rank, the columns of a result and first_seen for each row of ``queries`` (query_id, query, and document_slug where a query is limited to a document).

    Each query has the result it has alone; queries of one text (and document) are answered once. Different ones come in blocks of ``block`` (``search.QUERY_BLOCK``): a block is one scan of the
    chunks and one of the elements. ``embed_all`` gets each wording of a block once and returns a vector or None for each; null queries count as empty, a query limited to an unknown document finds nothing.
    """
    from . import search

    spark, parts, some = queries.sparkSession, [], []
    names = ["query"] + ["document_slug"] * ("document_slug" in queries.columns)
    asking = queries.select("query_id", *[F.coalesce(c, F.lit("")).alias(f"of_{c}") for c in names])

    def ask(rows: list) -> None:
        texts = [r["of_query"] for r in rows]
        short = [search.keywords(x) for x in texts]
        wordings = list(dict.fromkeys(w for x, y in zip(texts, short) for w in (x, y) if w == x or len(y) > 2))
        vector = dict(zip(wordings, embed_all(wordings)))
        slugs = {r["of_document_slug"] for r in rows if "document_slug" in names} - {""}
        of: dict[str, list[int]] = {s: [] for s in slugs}
        for r in corpus.documents.where(F.col("slug").isin(*slugs)).select("slug", "id").collect() if slugs else []:
            of[r["slug"]].append(r["id"])
        asked = Asked()
        for r, x, y in zip(rows, texts, short):
            asked.add(x, y, vector.get, exact_words, of.get(r["of_document_slug"]) if "document_slug" in names else None)
        kinds = [corpus.chunk_rows()] * include_chunks + [corpus.element_rows()] * include_elements
        best = answers(kinds, asked, limit, search.MAX_DISTANCE if max_distance is None else max_distance, search.KEPT, exact_words)
        named = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "q int, " + ", ".join(f"of_{c} string" for c in names))
        best = best.join(F.broadcast(named), "q")
        parts.append(corpus.placed(best, few=len(rows) * limit <= search.FEW).select(*of_names, "rank", *search.RESULT, "first_seen"))

    of_names = [f"of_{c}" for c in names]
    for r in asking.select(*of_names).distinct().toLocalIterator():
        some.append(r)
        if len(some) == (block or search.QUERY_BLOCK):
            ask(some)
            some = []
    if some or not parts:
        ask(some)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return asking.join(out, of_names).select("query_id", "rank", *search.RESULT, "first_seen")
