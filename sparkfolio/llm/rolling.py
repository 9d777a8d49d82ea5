"""Hashes of byte windows, words and word shingles over many texts at a time, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are hashed at a time; a longer word is hashed on its own.
BLOCK = 1 << 20
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 18)
            inverse = pow(_BASE, -1, 1 << 64)
            cls.up = np.cumprod(np.append(np.uint64(1), np.full(size, _BASE, np.uint64)))
            cls.down = np.cumprod(np.append(np.uint64(1), np.full(size, inverse, np.uint64)))
        return cls.up, cls.down


def _running(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each window of ``gram`` bytes."""
    if len(data) < gram:
        return np.empty(0, np.uint64)
    up, down = Powers.of(len(data) + 1)
    total = _running(data, up)
    return mixed((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])


#: Bytes of a search term: ASCII letters and digits, and all of characters beyond ASCII.
TERM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word, words being what stands between ASCII white space, or else the runs of bytes that ``inside`` marks."""
    space = (data == 32) | ((data >= 9) & (data <= 13)) if inside is None else ~inside[data]
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    before[1:], after[:-1] = space, space
    inner = offsets[1:-1]
    before[inner] = True
    after[inner] = True
    start, end = np.flatnonzero(~space & before[:-1]), np.flatnonzero(~space & after[1:]) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], block by block."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a > BLOCK:
            out[i] = xxhash.xxh64_intdigest(data[a:b].tobytes())
        else:
            up, down = Powers.of(b - a + 1)
            total = _running(data[a:b], up)
            out[i:j] = (total[end[i:j] - a] - total[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    return mixed(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: 64-bit hashes in order, text by text, and how many each text has.

    A-Z count as lower case. A text of ``shingle`` words or fewer is one shingle, and so is one without words.
    """
    data = LOWER[data]
    start, end, text = word_bounds(data, offsets)
    word = word_hashes(data, start, end)
    texts = len(offsets) - 1
    count = np.bincount(text, minlength=texts)
    first = np.cumsum(count) - count
    step = [np.uint64(pow(_BASE, j + 1, 1 << 64)) for j in range(shingle)]
    n = max(0, len(word) - shingle + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(shingle):
        whole += word[j : j + n] * step[j]
    inside = text[:n] == text[shingle - 1 :] if n else np.zeros(0, bool)
    few = np.flatnonzero(count < shingle)
    short = np.zeros(len(few), np.uint64)
    for j in range(shingle - 1):
        has = count[few] > j
        short[has] += word[first[few[has]] + j] * step[j]
    hashes = mixed(np.concatenate([whole[inside], short]))
    owner = np.concatenate([text[:n][inside], few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    return hashes[new], np.bincount(owner[new], minlength=texts)


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of each stretch of ``count`` hashes (none is empty): bits set in over half of them."""
    out, first = np.empty(len(count), np.uint64), np.cumsum(count) - count
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(first, first[at] + 65536, "left")))
        ones = np.zeros((end - at, 64), np.int64)
        a, b = int(first[at]), int(first[end - 1] + count[end - 1])
        for i in range(a, b, 1 << 17):  # a long stretch adds up block by block
            some = hashes[i : min(b, i + (1 << 17))]
            bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inner = np.unique(np.maximum(first[at:end], i))
            inner = inner[inner < i + len(some)]
            owner = np.searchsorted(first[at:end], inner, "right") - 1
            np.add.at(ones, owner, np.add.reduceat(bits, inner - i, axis=0, dtype=np.int64))
        out[at:end] = np.packbits(ones * 2 > count[at:end, None], axis=1, bitorder="little").view(np.uint64).ravel()
        at = end
    return out
