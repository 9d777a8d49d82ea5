"""Model services as pluggable providers, and a deterministic one for tests."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, TRIES, PAUSE = 50, 3, 1.0


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Word hashes as a vector of length 1; equal texts have equal vectors on any machine."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.size] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length == 0, 1, length)).tolist()


def with_retries(call: Callable, tries: int = TRIES, pause: float = PAUSE):
    """The call's result, or None once it has failed so many times."""
    for i in range(tries):
        try:
            return call()
        except Exception:  # a service may fail in any way
            if i + 1 < tries:
                time.sleep(pause)
    return None


def embed_column(rows: DataFrame, text: str, embedder: Embedder, batch: int = BATCH, pause: float = PAUSE) -> DataFrame:
    """``embedding`` of each text; null where its batch failed for good. Vectors come out with length 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done: list = []
            for i in range(0, len(frame), batch):
                part = [t or "" for t in frame[text].iloc[i : i + batch]]
                found = with_retries(lambda part=part: embedder(part), pause=pause)
                if found is None:
                    done += [None] * len(part)
                else:
                    v = np.array(found, np.float64).reshape(len(part), -1)
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    done += list((v / np.where(n == 0, 1, n)).astype(np.float32))
            yield frame.assign(embedding=done)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "embedding")
    return rows.drop("embedding").mapInPandas(run, schema + ", embedding array<float>")


def generate_column(rows: DataFrame, prompt: str, generator: Generator, name: str = "answer", where=None, pause: float = PAUSE) -> DataFrame:
    """``name`` holds the model's answer to each prompt that ``where`` holds for; null elsewhere and on failure."""

    @F.pandas_udf("string")
    def ask(part: pd.Series) -> pd.Series:
        return part.map(lambda p: None if p is None else with_retries(lambda: generator(p), pause=pause))

    asked = F.col(prompt) if where is None else F.when(where, F.col(prompt))
    return rows.withColumn(name, ask(asked))
