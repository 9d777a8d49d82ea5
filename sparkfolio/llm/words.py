"""Distinct pieces of many texts: a model that works on pieces runs once for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class PieceCache:
    """Numbers pieces as they come and keeps a row of ``compute`` for each, up to a bound.

    ``compute`` takes a list of pieces and returns an array with a row for each.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], most: int = 150_000):
        self._compute, self._most = compute, most
        self._number: dict = {}
        self._filled = 0
        self.rows: np.ndarray | None = None

    def numbers(self, pieces: list) -> np.ndarray:
        """Row numbers into ``rows``; those of an earlier call may hold no longer."""
        if len(self._number) > self._most:
            self._number, self.rows = {}, None
        known = self._number
        before = len(known)
        out = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
        if len(known) > before:
            new = list(known)[before:] if not before else [p for p, _ in zip(reversed(known), range(len(known) - before))][::-1]
            rows = self._compute(new)
            n = 0 if self.rows is None else self._filled
            if self.rows is None or n + len(rows) > len(self.rows):  # room to grow into, so that batches don't copy it each time
                room = np.empty((max(2 * n, n + len(rows)), *rows.shape[1:]), rows.dtype)
                if n:
                    room[:n] = self.rows[:n]
                self.rows = room
            self.rows[n : n + len(rows)] = rows
            self._filled = n + len(rows)
        return out
