"""Ranks of position vectors in numpy, over the flat positions and offsets of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed values of the rank: weight of plain text, the sum of 1 / j**2 over all j, and what places farther apart than FAR count.
WEIGHT, ALL_SQUARES, FAR, FAR_VALUE = 0.1, 1.64493406685, 100, 1e-30
#: Digits in which ranks are compared: a product of the same factors in another order differs in its last bits.
RANK_DIGITS = 9
#: Pairs of places that are looked at together.
PAIRS = 1 << 20


def ranks(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rank of each row by the places flat[begin[i, row]:end[i, row]] of each lexeme i; there is a place of each.

    One lexeme counts by the number of its places, several by the distances of all pairs of places of two of them.
    """
    lexemes, rows = begin.shape
    if lexemes == 1:
        count = end[0] - begin[0]
        squares = np.cumsum(1 / np.arange(1, int(count.max(initial=1)) + 1) ** 2)
        return WEIGHT * squares[count - 1] / ALL_SQUARES
    rest = np.ones(rows)
    for i in range(lexemes):
        for j in range(i + 1, lexemes):
            second = end[j] - begin[j]
            pairs = (end[i] - begin[i]) * second
            until = np.cumsum(pairs)
            a = 0
            while a < rows:
                b = max(a + 1, int(np.searchsorted(until, until[a] - pairs[a] + PAIRS, "right")))
                n = pairs[a:b]
                first = np.cumsum(n) - n
                of = np.repeat(np.arange(a, b), n)
                at = np.arange(int(n.sum())) - np.repeat(first, n)
                gap = np.abs(flat[begin[i, of] + at // second[of]] - flat[begin[j, of] + at % second[of]])
                near = np.where(gap > FAR, FAR_VALUE, 1 / (1.005 + 0.05 * np.exp(np.minimum(gap, FAR) / 1.5 - 2)))
                rest[a:b] *= np.multiply.reduceat(1 - np.sqrt(WEIGHT * WEIGHT * near), first)
                a = b
    return 1 - rest


def ranks_of_places(places: pa.Array) -> pa.Array:
    """Rank of each row of array<array<int>>: the places of each lexeme of a query, as many lexemes in every row; null stays null."""
    some = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros(len(places))
    if len(some):
        lists = places.take(pa.array(some)).flatten()
        offsets = np.asarray(lists.offsets, np.int64).reshape(-1)
        lexemes = len(lists) // len(some)
        out[some] = ranks(np.asarray(lists.values, np.int64), offsets[:-1].reshape(-1, lexemes).T, offsets[1:].reshape(-1, lexemes).T)
    return pa.array(out, mask=places.is_null().to_numpy(zero_copy_only=False))


class Lexemes:
    """Where a batch's rows have the lexemes of queries: of each lexeme the rows, and the begin and end of its places in ``flat``."""

    def __init__(self, vectors: pa.ListArray, lexemes: list[str]):
        entries = vectors.flatten()
        code = pc.fill_null(pc.index_in(entries.field("lexeme"), pa.array(lexemes, pa.string())), -1).to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        places = entries.field("positions")
        offsets = np.asarray(places.offsets, np.int64)
        self.flat = np.asarray(places.values, np.int64)
        found = np.flatnonzero(code >= 0)
        found = found[np.argsort(code[found], kind="stable")]  # rows of a lexeme stay in order
        row = np.repeat(np.arange(len(vectors)), size)[found]
        cut = np.searchsorted(code[found], np.arange(len(lexemes) + 1))
        self.of = [(row[a:b], offsets[found[a:b]], offsets[found[a:b] + 1]) for a, b in zip(cut, cut[1:])]

    def match(self, codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The rows that have all of the lexemes, and their ranks."""
        rows = self.of[codes[0]][0]
        for c in codes[1:]:
            rows = np.intersect1d(rows, self.of[c][0], assume_unique=True)
        at = [np.searchsorted(self.of[c][0], rows) for c in codes]
        begin = np.array([self.of[c][1][i] for c, i in zip(codes, at)])
        return rows, ranks(self.flat, begin, np.array([self.of[c][2][i] for c, i in zip(codes, at)])) if len(rows) else np.zeros(0)


class Words:
    """The same by whole words: how often each row has the words of queries; a row's rank is the share of its words."""

    def __init__(self, words: pa.ListArray, lexemes: list[str]):
        code = pc.fill_null(pc.index_in(words.flatten(), pa.array(lexemes, pa.string())), -1).to_numpy(zero_copy_only=False)
        self.size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), self.size)
        found = np.flatnonzero(code >= 0)
        key, count = np.unique(code[found].astype(np.int64) * max(len(words), 1) + row[found], return_counts=True)
        cut = np.searchsorted(key, np.arange(len(lexemes) + 1) * max(len(words), 1))
        self.of = [(key[a:b] % max(len(words), 1), count[a:b]) for a, b in zip(cut, cut[1:])]

    def match(self, codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.of[codes[0]][0]
        for c in codes[1:]:
            rows = np.intersect1d(rows, self.of[c][0], assume_unique=True)
        total = sum(self.of[c][1][np.searchsorted(self.of[c][0], rows)] for c in codes)
        return rows, total / self.size[rows]
