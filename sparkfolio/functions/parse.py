"""Parsing of model answers: element lists from a vision model, boxes and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, latex_of_description, strip

ITEM = "struct<bbox: array<double>, bbox_2d: array<double>, label: string, description: string>"
#: Boxes come too high by this share of the page's height.
SHIFT = 0.0106


def json_of_answer(answer: Column) -> Column:
    """The JSON of an answer: out of its fence, with lone backslashes doubled."""
    fenced = F.split(answer, "```json", 2)[1]
    plain = F.split(answer, "```", 3)[1]
    body = F.when(F.contains(answer, F.lit("```json")), F.split(fenced, "```", 2)[0]).when(F.contains(answer, F.lit("```")), plain).otherwise(answer)
    body = F.regexp_replace(body, r"\\\\", "\u0000")
    body = F.regexp_replace(body, r"\\(?![\"\\/bfnrtu])", "\u0000")
    return strip(F.regexp_replace(body, "\u0000", r"\\\\"))


def elements_of_answers(pages: DataFrame, answer: str = "answer", width: str = "width", height: str = "height") -> DataFrame:
    """A row for each element with a box of four numbers: the page's columns and type, bbox, bbox_pixels, label, description, latex, element_index.

    An answer that is no JSON object gives no rows, and neither do values that are no lists. Boxes are on a scale of 1000.
    """
    # Values are read as text first, so one that is no list spoils nothing else.
    kinds = F.from_json(json_of_answer(F.col(answer)), "map<string, string>")
    rows = pages.select("*", F.posexplode(F.map_entries(kinds)).alias("kind_index", "kind"))
    items = F.when(F.col("kind.value").rlike(rf"\A[{SPACE}]*\["), F.from_json(F.col("kind.value"), f"array<{ITEM}>"))
    rows = rows.select("*", F.posexplode(items).alias("item_index", "item"))
    given = F.col("item.bbox")
    box = F.when(given.isNotNull() & (F.size(given) > 0), given).otherwise(F.col("item.bbox_2d"))
    rows = rows.withColumn("bbox", box).filter(F.size("bbox") == 4)
    down = F.floor(F.lit(SHIFT) * F.col(height)).cast("int")
    x = lambda i: (F.col("bbox")[i] / 1000 * F.col(width)).cast("int")
    y = lambda i: (F.col("bbox")[i] / 1000 * F.col(height)).cast("int") + down
    kind = F.rtrim(F.col("kind.key"), F.lit("s"))
    description = F.coalesce("item.description", F.lit(""))
    rows = rows.select(
        *pages.columns,
        kind.alias("type"),
        "bbox",
        F.array(x(0), y(1), x(2), y(3)).alias("bbox_pixels"),
        F.coalesce("item.label", "kind.key").alias("label"),
        description.alias("description"),
        F.when(kind == "equation", F.nullif(latex_of_description(description), F.lit(""))).alias("latex"),
        (F.col("kind_index") * 100_000 + F.col("item_index")).alias("element_index"),
    )
    return rows


def crop_box(box: Column, width: Column, height: Column, padding: Column, scale: Column | int = 1000) -> Column:
    """Pixel box of a crop, padded and cut to the page; null for a box without area.

    A page whose scale is just 1000 is read as on the scale of 1000.
    """
    scale = F.lit(scale) if isinstance(scale, int) else scale
    x = lambda i: F.when(scale == 1000, (box[i] * width / 1000)).otherwise(box[i]).cast("int")
    y = lambda i: F.when(scale == 1000, (box[i] * height / 1000)).otherwise(box[i]).cast("int")
    inner = F.array(F.greatest(F.lit(0), x(0) - padding), F.greatest(F.lit(0), y(1) - padding), F.least(width, x(2) + padding), F.least(height, y(3) + padding))
    return F.when((F.size(box) == 4) & (x(2) > x(0)) & (y(3) > y(1)), inner)


def crop_padding(width: Column, height: Column) -> Column:
    return F.floor(F.lit(0.07) * F.least(width, height)).cast("int")


def rendered_size(width: Column, height: Column, most: int = 2048) -> Column:
    """Page size in pixels after the longest side is brought down to ``most``."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"))
