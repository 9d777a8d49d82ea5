"""Text cards of results and documents, drawing plans of boxes, LaTeX sources."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import color_of, strip
from .vectors import score_percent


def _percent() -> Column:
    return F.format_string("%.1f%%", F.bround(score_percent(F.col("score")), 1))


def _kind(other: str) -> Column:
    return F.upper(F.coalesce(F.nullif(F.col("element_type"), F.lit("")), F.lit(other)))


def result_card(verbose: bool = False) -> Column:
    """Two lines for a result, and with ``verbose`` the first 200 characters of its content."""
    title = F.when(F.col("source_type") == "element", F.concat(F.lit("["), _kind("unknown"), F.lit("] "), F.coalesce("element_label", F.lit("")))).otherwise(F.concat(F.lit("[TEXT] Chunk "), F.col("chunk_index").cast("string")))
    lines = [title, F.concat(F.lit("  Score: "), _percent(), F.lit(" | Page "), F.col("page_number").cast("string"), F.lit(" | "), "document_title")]
    if verbose:
        lines.append(F.concat(F.lit("  "), F.left("content", F.lit(200)), F.lit("...")))
    return F.concat_ws("\n", *lines)


def tool_card(rank: Column) -> Column:
    """A result with what is needed to ask for it again: document, label and page."""
    title = F.when(F.col("source_type") == "element", F.concat(_kind("element"), F.lit(": "), F.coalesce("element_label", F.lit("")))).otherwise("TEXT CHUNK")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title),
        F.concat(F.lit("  Document: "), "document_slug"),
        F.concat(F.lit("  Page: "), F.col("page_number").cast("string")),
        F.concat(F.lit("  Score: "), _percent()),
        F.concat(F.lit("  Content: "), F.left("content", F.lit(300)), F.lit("...")),
    )


def document_card() -> Column:
    summary = F.when(F.length("summary") > 200, F.concat(F.left("summary", F.lit(200)), F.lit("..."))).otherwise(F.nullif(F.col("summary"), F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("## "), "title", F.lit(" ("), "slug", F.lit(")")), F.concat(F.lit("   Pages: "), F.col("page_count").cast("string")), F.concat(F.lit("   Summary: "), summary))


def drawn_box(bbox_pixels: Column, bbox: Column, width: Column, height: Column, kind: Column) -> Column:
    """box and color of an element on its page's image: pixels where known, else the box, scaled if all of it is within 1000. Null without a box of four."""
    scaled = F.forall(bbox, lambda v: (v >= 0) & (v <= 1000))
    side = lambda i: F.when(scaled, bbox[i] * (width if i % 2 == 0 else height) / 1000).otherwise(bbox[i]).cast("int")
    box = F.when(F.size(bbox_pixels) == 4, F.transform(bbox_pixels, lambda v: v.cast("int"))).when(F.size(bbox) == 4, F.array(*map(side, range(4))))
    return F.when(box.isNotNull(), F.struct(box.alias("box"), color_of(kind).alias("color")))


def latex_source(latex: Column) -> Column:
    """A document that shows the formula alone: aligned where it has columns or cases, else as displayed math. Null for no formula."""
    body = F.btrim(F.replace(F.replace(strip(latex), F.lit("\\("), F.lit("")), F.lit("\\)"), F.lit("")), F.lit("$"))
    aligned = F.contains(body, F.lit("\\begin{align")) | F.contains(body, F.lit("&")) | F.contains(body, F.lit("\\begin{cases}"))
    math = F.when(aligned & ~body.startswith("\\begin{"), F.concat(F.lit("\\begin{align*}\n"), body, F.lit("\n\\end{align*}"))).when(aligned, body).otherwise(F.concat(F.lit("$\\displaystyle "), body, F.lit("$")))
    head = "\\documentclass[preview,border=2pt]{standalone}\n\\usepackage{amsmath}\n\\usepackage{amssymb}\n\\begin{document}\n"
    return F.when(F.length(latex) > 0, F.concat(F.lit(head), math, F.lit("\n\\end{document}\n")))


def pages_of_spec(spec: str, total: int) -> list[int]:
    """Page numbers of ``all``, ``a-b`` or ``a,b,c``."""
    if spec.strip().lower() == "all":
        return list(range(1, total + 1))
    if "-" in spec and "," not in spec:
        first, last = spec.split("-", 1)
        return list(range(int(first), int(last) + 1))
    return [int(x) for x in spec.split(",")]


def indexes_of(text: str) -> list[int]:
    """Places from 0 of a list like ``1,2 3``; raises ValueError on anything else."""
    return [int(x) - 1 for x in re.split(r"[,\s]+", text.strip()) if x]
