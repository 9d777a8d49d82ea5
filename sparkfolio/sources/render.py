"""Page images through a provider: rendering, detection of elements, and copies of images."""

from __future__ import annotations

import re
import shutil
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.parse import elements_of_answers
from ..operators.providers import Generator, generate_column

RENDERED = "path string, page_number int, width int, height int, image binary, text string"


class Renderer(Protocol):
    """(page_number, width, height, PNG bytes, text) of the pages of a file, brought down to ``most`` pixels on the longest side."""

    def __call__(self, content: bytes, dpi: int, most: int) -> Iterator[tuple[int, int, int, bytes, str]]: ...


def render_files(spark: SparkSession, path: str, renderer: Renderer, dpi: int = 150, most: int = 2048) -> DataFrame:
    """A row for each page of each file, with margin line numbers taken out of its text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                for number, width, height, image, words in renderer(bytes(content), dpi, most):
                    yield pd.DataFrame([(name, number, width, height, image, words)], columns=["path", "page_number", "width", "height", "image", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, RENDERED).withColumn("text", text.strip_line_numbers(F.col("text")))


def detect_elements(pages: DataFrame, vision: Generator, instruction: str = "List figures, tables, equations, charts and diagrams as JSON.", **more) -> DataFrame:
    """Elements that a vision model finds on rendered pages; a failed call gives none."""
    asked = pages.withColumn("prompt", F.concat(F.lit(instruction + "\ndata:image/png;base64,"), F.base64("image"))).drop("image")
    return elements_of_answers(generate_column(asked, "prompt", vision, **more).drop("prompt"))


def copy_to_cache(image: str, cache: str, label: str) -> str:
    """Copies an image into a folder under a name made of its label; returns the copy's path."""
    target = Path(cache) / (re.sub(r"[^\w\-]", "_", label) + Path(image).suffix)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(image, target)
    return str(target)
