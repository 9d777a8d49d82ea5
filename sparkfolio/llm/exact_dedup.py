"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is the polynomial of its bytes (A-Z lower-cased) at two bases, modulo two
31-bit primes. Fingerprints of neighbouring chunks combine by length-shifted arithmetic,
``H(ab) = H(a) * B**len(b) + H(b)``, so chunks of a huge text can be hashed anywhere and in any
order, and parts of it are, by several workers. Rows of equal length and fingerprint are then compared chunk by chunk with the row that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, id_text, is_empty, kept_rows, materialise, shuffle_width, slices, text_hash, tidy, utf8
from .rolling import LOWER

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 69069069)
#: Bytes of a chunk, and chunks that are hashed at a time.
CHUNK, CHUNKS = 16384, 256
COMPARE = 65536
#: A text of more bytes is hashed in parts of as many by several workers.
HUGE = 1 << 23
SALT_ROWS = 256


def powers(n: int, primes=PRIMES) -> np.ndarray:
    """Row k: base k to the powers 0 to n - 1."""
    out = np.ones((len(primes), n), np.uint64)
    for k, (p, b) in enumerate(zip(primes, BASES)):
        done, step = 1, b % p
        while done < n:  # doubling: the next block is this block times base ** done
            m = min(done, n - done)
            out[k, done : done + m] = out[k, :m] * np.uint64(step) % np.uint64(p)
            done, step = done + m, step * step % p
    return out


def combine(left: tuple, right: tuple, primes=PRIMES) -> tuple:
    """(length, hashes) of two neighbouring chunks give those of both together."""
    n, hs = right
    return left[0] + n, tuple((a * pow(b, n, p) + h) % p for a, h, b, p in zip(left[1], hs, BASES, primes))


def chunk_hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, primes=PRIMES) -> np.ndarray:
    """One row of hashes for each chunk data[bounds[i]:bounds[i + 1]]; no chunk is empty or over the table's length."""
    size = np.diff(bounds)
    place = np.repeat(bounds[1:] - 1, size) - np.arange(bounds[0], bounds[-1])
    out = np.empty((len(size), len(primes)), np.uint64)
    for k, p in enumerate(primes):  # a product is under 2**39, so 2**25 of them add up safely
        out[:, k] = np.add.reduceat(data.astype(np.uint64) * table[k][place], bounds[:-1]) % np.uint64(p)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, primes=PRIMES, table=None) -> list[tuple]:
    """(length, hashes) of each text in ``data`` from the combined hashes of its chunks."""
    table = powers(chunk, primes) if table is None else table
    size = np.diff(offsets)
    count = -(-size // chunk)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(size)), count)
    begin = offsets[:-1][owner] + (np.arange(count.sum()) - first[owner]) * chunk
    bounds, hashes = np.append(begin, offsets[-1]), []
    for i in range(0, len(begin), CHUNKS):
        some = bounds[i : i + CHUNKS + 1]
        hashes += chunk_hashes(data[some[0] : some[-1]], some - some[0], table, primes).tolist()
    out = []
    for n, c, f in zip(size.tolist(), count.tolist(), first.tolist()):
        whole = (0, (0,) * len(primes))
        for i in range(c):
            whole = combine(whole, (min(chunk, n - i * chunk), hashes[f + i]), primes)
        out.append(whole)
    return out


def _fingerprint_rows(primes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = powers(CHUNK, primes)
        for batch in slices(batches, "text"):
            data, off = utf8(batch.column("text"))
            data = LOWER[data]
            whole = memoryview(data)
            found = fingerprints(data, off, primes=primes, table=table)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "th": batch.column("th"),
                    "n_bytes": pa.array([n for n, _ in found], pa.int64()),
                    "fp": pa.array([h[0] << 31 | h[1] for _, h in found], pa.int64()),
                    "text_sha256": pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:])], pa.string()),
                }
            )

    return run


def _part_rows(primes):
    """Hashes of parts of huge texts, each shifted by the bytes that follow it in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = powers(CHUNK, primes)
        for batch in slices(batches, "part"):
            data, off = utf8(batch.column("part"))
            found = fingerprints(LOWER[data], off, primes=primes, table=table)
            after = (np.diff(off), batch.column("begin").to_numpy(), batch.column("n_bytes").to_numpy())
            rows = [[h * pow(b, int(n - at - size), p) % p for h, b, p in zip(hs, BASES, primes)] for (_, hs), size, at, n in zip(found, *after)]
            kept = {k: batch.column(k) for k in ("doc_id", "th", "n_bytes", "text_sha256", "row")}
            yield pa.record_batch(kept | {f"h{i}": pa.array([r[i] for r in rows], pa.int64()) for i in range(2)})

    return run


def _huge(docs: DataFrame, kind: str, primes, huge: int) -> DataFrame:
    """The same rows for texts of over ``huge`` bytes, whose parts are hashed by any worker and added up."""
    folded = F.encode(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "UTF-8")
    n = F.octet_length("text").cast("long")
    whole = docs.select("doc_id", "th", n.alias("n_bytes"), F.sha2(folded, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"), F.encode("text", "UTF-8").alias("raw"))
    cut = F.expr(f"transform(sequence(0L, (n_bytes - 1) div {huge}), i -> struct(i * {huge} as begin, substring(raw, cast(i * {huge} + 1 as int), {huge}) as part))")
    parts = whole.select("doc_id", "th", "n_bytes", "text_sha256", "row", F.explode(cut).alias("p")).select("doc_id", "th", "n_bytes", "text_sha256", "row", "p.*")
    parts = parts.repartition(shuffle_width(docs.sparkSession), "row", "begin")
    hashed = parts.mapInArrow(tidy(_part_rows(primes)), f"doc_id {kind}, th long, n_bytes long, text_sha256 string, row long, h0 long, h1 long")
    added = [F.pmod(F.sum(f"h{i}"), F.lit(p)) for i, p in enumerate(primes)]  # each is under 2**31, so 2**32 parts add up safely
    fp = F.shiftleft(added[0], 31).bitwiseOR(added[1])
    return hashed.groupBy("doc_id", "th", "n_bytes", "text_sha256", "row").agg(fp.alias("fp")).select("doc_id", "th", "n_bytes", "fp", "text_sha256")


def same_bytes(a: np.ndarray, b: np.ndarray, step: int = COMPARE) -> bool:
    """Compares the bytes of two texts chunk by chunk, A-Z lower-cased, and stops at the first difference."""
    return len(a) == len(b) and all((LOWER[a[i : i + step]] == LOWER[b[i : i + step]]).all() for i in range(0, len(a), step))


def same_text(a: str | None, b: str | None, step: int = COMPARE) -> bool:
    return same_bytes(*(np.frombuffer((x or "").encode(), np.uint8) for x in (a, b)), step)


def _compare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        (x, i), (y, j) = (utf8(batch.column(c)) for c in ("text", "stay_text"))
        bad = [not same_bytes(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]) for k in range(batch.num_rows)]
        yield pa.record_batch({k: batch.column(k) for k in ("fp", "n_bytes")}).filter(pa.array(bad, pa.bool_()))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, fp, th (``text_hash``).

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays.
    Null text counts as empty, and all empty texts form a group. Rows that repeat an id are
    rows of their own in group_size and have the same ``kept``. A null id never stays unless its
    group has no other. An empty table gives no rows. Every row but the one that stays is compared with it, chunk by chunk;
    rows equal in id and by ``th`` are compared once. Fingerprint groups in which a comparison
    fails are split by SHA-256.
    """
    docs = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash("text").alias("th"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    large = F.octet_length("text") > huge
    fp = docs.filter(~large).mapInArrow(tidy(_fingerprint_rows(primes)), f"doc_id {kind}, th long, n_bytes long, fp long, text_sha256 string")
    fp = materialise(fp.unionByName(_huge(docs.filter(large), kind, primes, huge)))
    row = F.struct("doc_id", "th")
    groups = fp.groupBy("fp", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max(row)["th"].alias("stay_th"))
    # Both sides come from tables, so AQE can split the partition of a group that holds most rows.
    assigned = materialise(fp.join(materialise(groups), ["fp", "n_bytes"]))

    # Members meet the text that stays: a group is dealt over a salt for each SALT_ROWS of its rows.
    many = assigned.filter("group_size > 1").select(F.col("doc_id").alias("many_id"), F.col("th").alias("many_th"), "fp", "n_bytes", "keep_id", "group_size", "stay_th").distinct()
    many = materialise(many)
    maybe = docs.filter(BitFilter(many.select("many_th")).column(F.col("th"))).dropDuplicates(["doc_id", "th"])
    text = materialise(maybe.join(many, F.col("doc_id").eqNullSafe(F.col("many_id")) & (F.col("th") == F.col("many_th"))).drop("many_id", "many_th"))
    salts = F.ceil(F.col("group_size") / SALT_ROWS)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("stay_th"))
    stay = text.filter(stays).select("fp", "n_bytes", F.col("text").alias("stay_text"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    rest = text.filter(~stays).withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), salts))
    met = rest.join(stay, ["fp", "n_bytes", "salt"]).select("fp", "n_bytes", "text", "stay_text")
    wrong = materialise(met.mapInArrow(tidy(_compare_rows), "fp long, n_bytes long").distinct())
    assigned = assigned.drop("stay_th")
    if not is_empty(wrong):
        mixed = fp.join(wrong, ["fp", "n_bytes"], "left_semi")
        split = mixed.groupBy("fp", "n_bytes", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        assigned = assigned.join(wrong, ["fp", "n_bytes"], "left_anti").unionByName(mixed.join(split, ["fp", "n_bytes", "text_sha256"]))
    return assigned.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes", "fp", "th")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``: that of the largest id, and of rows with that id, that of the largest text hash.

    Null texts count as empty, null ids come last; of rows equal in id and text, one stays; an empty table stays empty; columns of any name stay as they are.
    """
    judged = materialise(exact_duplicates(docs, id_col, text_col))
    group = ["fp", "n_bytes", "text_sha256"]
    several = materialise(judged.filter("kept").groupBy(group).agg(F.min("th").alias("least"), F.max("th").alias("stay_th")).filter("least <> stay_th").drop("least"))
    if not is_empty(several):
        judged = materialise(judged.join(several, group, "left").withColumn("kept", F.col("kept") & (F.col("stay_th").isNull() | (F.col("th") == F.col("stay_th")))))
    return kept_rows(docs, judged, id_col, text_col)
