"""Quality rules by repetition: characters inside duplicated n-grams and lines.

Words are hashed, and a running polynomial sum over the word hashes of a text gives the hash of any run of words.
Runs of 5 words are sorted by hash; a longer run can only stand twice where both of the shorter runs in it do, so each
further length sorts what the length before left. All of it is numpy over whole texts inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, tidy, utf8
from .rolling import Powers, mixed, word_bounds, word_hashes

#: By words of a run, the per cent of a text's characters that may stand in runs that repeat an earlier one. Published limits go down to 10 for runs of 10 words; those
#: reject short texts for one line that stands at the top and again at the end, which is no fault of the text.
GRAM_LIMITS = dict.fromkeys(range(5, 11), 20)
#: The same for lines that repeat an earlier line.
LINE_LIMIT = 20
#: Fixed values of the base rule.
LEAST_WORDS, REPEAT_GRAM, REPEAT_LIMIT = 20, 8, 30
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in GRAM_LIMITS))


def _own(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of things that count as equal inside one text only."""
    return mixed(hashes + mixed(text.astype(np.uint64) + np.uint64(1)))


def _found_again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys are found twice or more, and which of them equal an earlier one."""
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    some = np.flatnonzero(twice)
    later = np.zeros(len(keys), bool)
    _, first = np.unique(keys[some], return_index=True)  # the first of equal values
    later[some] = True
    later[some[first]] = False
    return twice, later


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in runs of ``length`` places from ``starts``."""
    step = np.zeros(n + 1, np.int64)
    step[starts] += 1
    step[starts + length] -= 1
    return np.cumsum(step[:-1]) > 0


def coverage(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``COLUMNS`` of each text, whose bytes are data[offsets[i]:offsets[i + 1]]."""
    texts = len(offsets) - 1
    start, end, text = word_bounds(data, offsets)
    if not len(start):
        return {c: np.zeros(texts, np.int64) for c in COLUMNS}
    chars_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars_before[1:])
    chars = chars_before[end] - chars_before[start]
    del chars_before
    total = lambda where, what=None: np.bincount(where, what, texts).astype(np.int64)
    marks = np.flatnonzero(SYMBOLS[data])
    out = {"n_words": total(text), "word_chars": total(text, chars), "n_symbols": total(np.searchsorted(offsets, marks, "right") - 1)}

    # Lines with a word.
    inner = offsets[:-1][np.diff(offsets) > 0]
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([inner, breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    stop -= (data[stop - 1] == 10).astype(stop.dtype)  # without the line's end
    first = np.searchsorted(start, begin)
    words = np.searchsorted(start, stop) - first
    has = words > 0
    begin, stop, first, words = begin[has], stop[has], first[has], words[has]
    line_chars = np.add.reduceat(chars, first)
    line_text = text[first]
    _, later = _found_again(_own(word_hashes(data, begin, stop), line_text))
    out["n_dup_lines"] = total(line_text[later])
    line_chars = total(line_text[later], line_chars[later])

    # Runs of words.
    up, down = Powers.of(len(start) + 1)
    running = np.zeros(len(start) + 1, np.uint64)
    np.cumsum(word_hashes(data, start, end) * up[: len(start)], out=running[1:])
    at = np.arange(len(start))
    grams = {}
    for n in GRAM_LIMITS:
        at = at[at + n <= len(start)]
        at = at[text[at] == text[at + n - 1]]
        twice, later = _found_again(_own((running[at + n] - running[at]) * down[at], text[at]))
        if n == REPEAT_GRAM:
            out["n_repeat_words"] = total(text[_covered(at[twice], n, len(start))])
        inside = _covered(at[later], n, len(start))
        grams[f"dup_chars_{n}"] = total(text[inside], chars[inside])
        at = at[twice]
        at = at[np.isin(at + 1, at, assume_unique=True)]  # a run of one more word starts with both
    return out | {"dup_line_chars": line_chars} | grams


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = coverage(*utf8(batch.column("text")))
        yield pa.record_batch({"doc_id": batch.column("doc_id")} | {c: pa.array(found[c], pa.int64()) for c in COLUMNS})


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT) -> DataFrame:
    """One row per input row: doc_id, the measures of ``COLUMNS``, base_failed, kept.

    A text fails the base rule with under 20 words, or with over 30 % of them in runs of 8 words found twice or more (the first included). Of the others
    a text is kept unless the characters in lines that repeat an earlier one are over ``line_limit`` per cent of those of all words, or the characters in runs
    of n words that repeat an earlier run over ``gram_limits[n]`` per cent. Null counts as empty, and an empty text fails the base rule; rows that repeat are judged
    each on its own; an empty table gives no rows. Words, runs and lines are equal by 64-bit hashes; memory is linear in the longest text.
    """
    mine = id_text(docs, id_col, text_col)
    measures = ", ".join(f"{c} long" for c in COLUMNS)
    out = mine.mapInArrow(tidy(_measured), f"doc_id {mine.schema['doc_id'].dataType.simpleString()}, {measures}")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_LIMIT * F.col("n_words"))
    over = 100 * F.col("dup_line_chars") > line_limit * F.col("word_chars")
    for n, limit in (gram_limits or GRAM_LIMITS).items():
        over = over | (100 * F.col(f"dup_chars_{n}") > limit * F.col("word_chars"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & ~over)
