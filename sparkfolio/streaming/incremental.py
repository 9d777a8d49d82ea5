"""Resumable ingestion: files that come in are added once, whatever was there before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_pages
from ..sources import schemas
from ..sources.corpus import file_path


def page_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """Page files of an extraction tree as they come."""
    stream = spark.readStream.schema(schemas.PAGE_JSON).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(f"{root}/*/pages")
    path = file_path()
    return stream.withColumns({"slug": F.regexp_extract(path, r"([^/]+)/pages/[^/]+$", 1), "came": F.struct(F.col("_metadata.file_modification_time").alias("time"), path.alias("path"))})


def append_new(batch: DataFrame, target: str, key: list[str]) -> None:
    """Adds the rows whose key the table at ``target`` lacks; running it again adds nothing."""
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    new = batch.dropDuplicates(key)
    if there:
        new = new.join(spark.read.schema(batch.schema).parquet(target).select(*key).distinct(), key, "left_anti")
    new.write.mode("append").parquet(target)


def ingest_available(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunks of all pages that came since the last run, appended to ``target``; ends when none is left."""

    def add(batch: DataFrame, _: int) -> None:
        first = batch.groupBy("slug", "page_number").agg(F.min_by(F.struct("text"), "came").alias("page"))  # of several files for one page the first counts
        pages = first.select("slug", "page_number", F.coalesce("page.text", F.lit("")).alias("full_text"))
        append_new(chunk_pages(pages), target, ["slug", "page_number", "chunk_index"])

    return page_stream(spark, root).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pages_per_minute(progress: DataFrame, window: str = "1 minute") -> DataFrame:
    """Rate of (event_time, …) rows by window, late rows up to one window."""
    return progress.withWatermark("event_time", window).groupBy(F.window("event_time", window)).agg(F.count(F.lit(1)).alias("pages"))
