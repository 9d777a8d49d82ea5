"""Overlapping chunks that end at natural breaks, as a table-generating operator."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.batches import SLICE, slices, small_batches, tidy
from ..functions.text import clean_text
from .numbering import running_number

SIZE, OVERLAP = 800, 200
CHUNK = StructType([*(StructField(c, IntegerType()) for c in ("chunk_index", "start_char", "end_char")), StructField("content", StringType())])
#: What ends a sentence (the right-most of any wins) and a clause (the first kind that occurs wins).
SENTENCE = (". ", ".\n", "! ", "!\n", "? ", "?\n")
CLAUSE = (", ", "; ", ": ")


def break_point(text: str, low: int, end: int) -> int:
    """Where a chunk that would end at ``end`` does end: in ``text[low:end]`` after a paragraph, else a sentence, clause or word."""

    def last(mark: str) -> int:
        return text.rfind(mark, low, end)

    at = last("\n\n")
    if at < 0:
        at = max(map(last, SENTENCE))
    if at < 0:
        at = next((p for p in map(last, CLAUSE) if p >= 0), -1)
    if at >= 0:
        return at + 2
    at = last(" ")
    return at + 1 if at >= 0 else end


def check_sizes(size: int, overlap: int) -> None:
    """A chunk may end a fifth of its size early; an overlap beyond what is left would never move on."""
    if size < 1 or overlap < 0 or overlap >= size - size // 5:
        raise ValueError(f"an overlap of {overlap} does not fit chunks of {size}")


def chunks_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP, respect_sentences: bool = True) -> Iterator[tuple[int, int, int, str]]:
    """(index, start, end, content) of each chunk. Offsets are in the stripped text; content is stripped once more, and blank chunks are left out."""
    check_sizes(size, overlap)
    text = (text or "").strip()
    if len(text) <= size:
        if text:
            yield 0, 0, len(text), text
        return
    index = start = 0
    while True:
        end = start + size
        if end >= len(text):
            end = len(text)
        elif respect_sentences:
            end = break_point(text, max(start, end - size // 5), end)
        if content := text[start:end].strip():
            yield index, start, end, content
            index += 1
        if end >= len(text):
            return
        start = end - overlap


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, respect_sentences: bool = True) -> list[tuple[int, int, int, str]]:
    return list(chunks_of(text, size, overlap, respect_sentences))


def _chunk_batches(text: str, kept: list[str], settings: tuple[int, int, bool], limit: int = SLICE):
    """Batches of chunks with the ``kept`` columns of their page. Texts come in slices and chunks go out in batches of about ``limit`` characters, so memory grows with neither the batch nor the longest text's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, limit):
            rows, found, chars = [], [], 0

            def out() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), *columns], [*kept, *CHUNK.names])

            for row, one in enumerate(batch.column(text)):
                for chunk in chunks_of(one.as_py(), *settings):
                    rows.append(row)
                    found.append(chunk)
                    chars += len(chunk[3])
                    if chars >= limit:
                        yield out()
                        rows, found, chars = [], [], 0
            if rows:
                yield out()

    return run


def chunk_pages(pages: DataFrame, text: str = "full_text", size: int = SIZE, overlap: int = OVERLAP, clean: bool = True, respect_sentences: bool = True) -> DataFrame:
    """A row for each chunk of each page, with the page's other columns. Indexes count within a page."""
    check_sizes(size, overlap)
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != text]
    source = pages.select(*kept, (clean_text(F.col(text)) if clean else F.col(text)).alias(text))
    schema = StructType([pages.schema[c] for c in kept] + CHUNK.fields)
    return source.mapInArrow(tidy(_chunk_batches(text, kept, (size, overlap, respect_sentences))), schema)


def with_global_index(chunks: DataFrame, document: str, page: str) -> DataFrame:
    """``global_index``: chunks of a document counted over its pages."""
    return running_number(chunks, [document], [page, "chunk_index"], "global_index", start=0)
