"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import SLICE, give_back, slices, small_batches, tidy  # noqa: F401

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset (tests, local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # snappy takes direct buffers, which executors keep
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and has the driver collect its garbage, since shuffle files stay until then."""
    paths = {t._written_at for t in tables}
    for entry in [e for e in _written if e[1] in paths]:
        _written.remove(entry)
        _delete(*entry)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def _remove() -> None:
    for entry in _written:
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def texts(col: pa.Array) -> list[str]:
    """Python strings of a text column; null is the empty text."""
    return ["" if x is None else x for x in col.to_pylist()]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column, one text after another, and its len + 1 offsets; null is the empty text."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, so that no other column can clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class BitFilter:
    """Which values are in a set: a bitmap of about eight bits for each, of 32 MB at most whatever the data.

    It has no false negatives. Beyond four million values it lets more through, so whatever uses it
    must still join exactly afterwards. ``hashed``: the values are spread 64-bit hashes themselves.
    """

    LEAST_BITS, MOST_BITS = 16, 28
    _PART = 32768  # bits of one map of bitmap_construct_agg

    def __init__(self, values: DataFrame, hashed: bool = False):
        name, self._hashed = values.columns[0], hashed
        self.bits = min(self.MOST_BITS, max(self.LEAST_BITS, (8 * values.count()).bit_length()))
        slot = self.slot_of(F.col(name))
        parts = values.filter(F.col(name).isNotNull()).groupBy((slot / self._PART).cast("long").alias("part")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(self._PART)).cast("long")).alias("bits"))
        whole = bytearray(1 << self.bits - 3)
        for row in parts.toLocalIterator():  # 8192 rows of 4 KB at most
            whole[row["part"] * 4096 : row["part"] * 4096 + len(row["bits"])] = row["bits"]
        self._shared = values.sparkSession.sparkContext.broadcast(bytes(whole))

    def slot_of(self, column):
        """The slot of a column, to be handed to ``has_slot``."""
        return F.pmod(column if self._hashed else F.xxhash64(column), F.lit(1 << self.bits))

    def has_slot(self, slots: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self._shared.value, np.uint8)
        return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether hashes may be in a set of hashes."""
        return self.has_slot((hashes.view(np.uint64) & np.uint64((1 << self.bits) - 1)).astype(np.int64))

    def column(self, column):
        """A boolean column: whether the value may be in the set."""
        look = F.arrow_udf(lambda slots: pa.array(self.has_slot(slots.to_numpy())), "boolean")
        return look(self.slot_of(column))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def text_hash(text_col: str) -> Column:
    """64 bits of a text; null counts as empty. With the row's id it tells rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and ``text_hash`` are in ``dropped`` (doc_id, th). Only rows whose text may be among those are shuffled.

    Null ids equal null ids; all rows of a dropped id and text go; nothing is dropped by an empty ``dropped``; columns of any name stay as they are.
    """
    th, mark, gone_id, gone_th = (free_name(docs, f"without_{x}") for x in ("th", "mark", "id", "gone"))
    dropped = dropped.select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th))
    some = BitFilter(dropped.select(gone_th))
    marked = docs.withColumn(th, text_hash(text_col))
    marked = marked.withColumn(mark, some.column(F.col(th)))
    rest = marked.filter(F.col(mark)).join(dropped, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(th) == F.col(gone_th)), "left_anti")
    return marked.filter(~F.col(mark)).unionByName(rest).drop(th, mark)


def kept_rows(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judged`` (doc_id, th, kept; a row for each of ``docs``) keeps, with all their columns; of rows equal in id and text, one."""
    out = without(docs, judged.filter("not kept").select("doc_id", "th").distinct(), id_col, text_col)
    again = materialise(judged.filter("kept").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id", "th"))
    if is_empty(again):
        return out
    th, again_id, again_th = (free_name(docs, f"again_{x}") for x in ("hash", "id", "th"))
    again_of = again.withColumnsRenamed({"doc_id": again_id, "th": again_th})
    some = docs.withColumn(th, text_hash(text_col)).join(again_of, F.col(id_col).eqNullSafe(F.col(again_id)) & (F.col(th) == F.col(again_th)), "left_semi")
    return without(out, again, id_col, text_col).unionByName(some.dropDuplicates([id_col, th]).drop(th))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
