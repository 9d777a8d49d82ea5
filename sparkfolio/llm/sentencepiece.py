"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

White space becomes the marker U+2581 with one in front of the text. A piece has the marker at its start only
(or is nothing but markers), so a text splits before markers into parts that are segmented on their own, and each
distinct part once. Parts of one batch go through the trie side by side. A character that no piece covers is spelled in byte pieces.
Decoding joins the pieces' bytes, turns markers into spaces and drops the first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, texts, tidy
from .words import PieceCache

MARK = "▁"
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Byte fallback costs this much below the worst piece, for each byte.
UNKNOWN = 10.0
#: Characters of a long text that are encoded at a time.
PIECE = 1 << 20
#: Bytes of text that are encoded at a time, and distinct parts that a worker remembers.
SLICE, REMEMBERED = 1 << 18, 60_000
#: Parts of more bytes than this are segmented one at a time.
SIDE_BY_SIDE = 48
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class DoubleArray:
    """State s goes by byte b to base[s] + b + 1 if check of that is s. ``value`` is the piece that ends at a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        rest = sorted(keys)
        work, hint, wide = [(0, 0, len(rest), 0)], 257, 257  # states of several children search from ``wide`` on, so that full stretches are crossed once
        while work:
            state, a, b, depth = work.pop()
            if a < b and len(rest[a]) == depth:
                value[state] = keys[rest[a]]
                a += 1
            groups: list[tuple[int, int, int]] = []
            while a < b:
                c, e = rest[a][depth], a
                while e < b and rest[e][depth] == c:
                    e += 1
                groups.append((c, a, e))
                a = e
            if not groups:
                continue
            while check[hint] != -1:
                hint += 1
                if hint + 600 > len(check):
                    base, check, value = base + [0] * len(base), check + [-1] * len(check), value + [-1] * len(value)
            tries, at = 0, max(0, (hint if len(groups) == 1 else max(hint, wide)) - groups[0][0] - 1)
            while True:
                while at + 600 > len(check):
                    base, check, value = base + [0] * len(base), check + [-1] * len(check), value + [-1] * len(value)
                if all(check[at + c + 1] == -1 for c, _, _ in groups):
                    break
                at, tries = at + 1, tries + 1
            if len(groups) > 1 and tries > 16:
                wide = at + groups[0][0] + 1
            base[state] = at
            for c, _, _ in groups:
                check[at + c + 1] = state
            work += [(at + c + 1, x, y, depth + 1) for c, x, y in groups]
        return cls(*(np.array(x, np.int32) for x in (base, check, value)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        to = self.base[state] + byte + 1
        return np.where(self.check[to] == state, to, -1)


@dataclass
class Pieces:
    """A vocabulary: its trie, log scores, byte pieces (-1 where there is none) and each piece's text as bytes."""

    trie: DoubleArray
    score: np.ndarray
    byte: np.ndarray
    surface: list[bytes]
    unknown: int = 0

    def __post_init__(self):
        self.least = float(self.score.min(initial=0.0)) - UNKNOWN

    @classmethod
    def of(cls, pieces: list[tuple[str, float]], byte_pieces: dict[int, int], skip: set[int] = frozenset(), unknown: int = 0) -> Pieces:
        byte = np.full(256, -1, np.int64)
        for b, i in byte_pieces.items():
            byte[b] = i
        plain = {p.encode(): i for i, (p, _) in enumerate(pieces) if i not in skip and i not in byte_pieces.values() and p}
        surface = [b"" if i in skip else p.encode() for i, (p, _) in enumerate(pieces)]
        for b, i in byte_pieces.items():
            surface[i] = bytes((b,))
        return cls(DoubleArray.build(plain), np.array([s for _, s in pieces], np.float64), byte, surface, unknown)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        """From a SentencePiece model. Unigram models hold log scores. BPE models hold ranks instead; there, the log score of rank r is -ln(r + 2), as by Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        raw = [model.get_score(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        ranked = [-s for i, s in enumerate(raw) if i not in special and i not in byte.values() and s > -1e8]
        if ranked and max(ranked) > 1000:
            least = -np.log(max(ranked) + 2)
            raw = [float(-np.log(2 - s)) if s > -1e8 else float(least) for s in raw]
        return cls.of([(model.id_to_piece(i), s) for i, s in enumerate(raw)], byte, special, model.unk_id())

    def viterbi(self, part: bytes) -> list[int]:
        """Best pieces of one part, character by character."""
        n, trie = len(part), self.trie
        base, check, value, least = trie.base, trie.check, trie.value, self.least
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            state = 0
            for j in range(i, n):
                to = base[state] + part[j] + 1
                if check[to] != state:
                    break
                state = to
                if (p := value[state]) >= 0 and best[i] + self.score[p] > best[j + 1]:
                    best[j + 1], back[j + 1] = best[i] + self.score[p], (i, int(p))
            e = i + 1
            while e < n and part[e] & 0xC0 == 0x80:
                e += 1
            if part[i] & 0xC0 != 0x80 and best[i] + least * (e - i) > best[e]:
                best[e], back[e] = best[i] + least * (e - i), (i, -1)
        out, at = [], n
        while at:
            i, p = back[at]
            out += [p] if p >= 0 else self._spell(part[i:at])[::-1]
            at = i
        return out[::-1]

    def _spell(self, char: bytes) -> list[int]:
        ids = [int(self.byte[b]) for b in char]
        return ids if min(ids) >= 0 else [self.unknown]

    def viterbi_all(self, parts: list[bytes]) -> list[list[int]]:
        """The same for many short parts side by side: one pass over places, each with a walk down the trie for all parts."""
        n = len(parts)
        size = np.fromiter(map(len, parts), np.int64, n)
        width = int(size.max(initial=0))
        text = np.zeros((width + 1, n), np.int32)  # by place, then part
        flat = np.frombuffer(b"".join(parts), np.uint8)
        row = np.repeat(np.arange(n), size)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = flat
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        start, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        lead = (text & 0xC0) != 0x80
        for i in range(width):
            live = np.flatnonzero((size > i) & (best[i] > -np.inf))
            from_here = best[i, live]
            # A character in bytes.
            char = live[lead[i, live]]
            end = np.full(len(char), i + 1)
            for _ in range(3):
                inside = end < size[char]
                inside[inside] = ~lead[end[inside], char[inside]]
                end += inside
            cost = best[i, char] + self.least * (end - i)
            better = cost > best[end, char]
            e, c = end[better], char[better]
            best[e, c], start[e, c], piece[e, c] = cost[better], i, -1
            # Pieces.
            state, j = np.zeros(len(live), np.int32), i
            while len(live) and j < width:
                state = self.trie.step(state, text[j, live])
                go = (state >= 0) & (size[live] > j)
                live, state, from_here = live[go], state[go], from_here[go]
                j += 1
                p = self.trie.value[state]
                some = p >= 0
                at, p, cost = live[some], p[some], from_here[some] + self.score[p[some]]
                better = cost > best[j, at]
                at, p = at[better], p[better]
                best[j, at], start[j, at], piece[j, at] = cost[better], i, p
        out: list[list[int]] = [[] for _ in range(n)]
        at, live = size.copy(), np.flatnonzero(size > 0)
        while len(live):
            end = at[live]
            for k, e, i, p in zip(live.tolist(), end.tolist(), start[end, live].tolist(), piece[end, live].tolist()):
                if p >= 0:
                    out[k].append(p)
                else:
                    out[k] += self._spell(parts[k][i:e])[::-1]
            at[live] = start[end, live]
            live = live[at[live] > 0]
        for ids in out:
            ids.reverse()
        return out

    def encode_parts(self, parts: list[bytes]) -> np.ndarray:
        """Pieces of each part, as an array of arrays."""
        out = np.empty(len(parts), object)
        short = [i for i, p in enumerate(parts) if len(p) <= SIDE_BY_SIDE]
        short.sort(key=lambda i: len(parts[i]))
        for a in range(0, len(short), 8192):
            some = short[a : a + 8192]
            for i, ids in zip(some, self.viterbi_all([parts[i] for i in some])):
                out[i] = np.array(ids, np.int32)
        for i, p in enumerate(parts):
            if len(p) > SIDE_BY_SIDE:
                out[i] = np.array(self.viterbi(p), np.int32)
        return out

    def encoder(self) -> PieceCache:
        return PieceCache(self.encode_parts, REMEMBERED)

    def encode(self, documents: list[str], cache: PieceCache | None = None) -> list[np.ndarray]:
        """Piece ids of each text; the empty text has none."""
        cache = cache or self.encoder()
        if any(len(d) > PIECE for d in documents):  # a long text goes in pieces, each of which has the blank before it as its marker
            return [np.concatenate([self._encode([p], cache)[0] for p in pieces_of(d)] or [np.empty(0, np.int32)]) for d in documents]
        return self._encode(documents, cache)

    def _encode(self, documents: list[str], cache: PieceCache) -> list[np.ndarray]:
        split = [parts_of(d) for d in documents]
        flat = [p for s in split for p in s]
        rows = cache.numbers(flat)
        out, at = [], 0
        for s in split:
            out.append(np.concatenate(cache.rows[rows[at : at + len(s)]]) if s else np.empty(0, np.int32))
            at += len(s)
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of piece ids: bytes joined, markers as spaces, without the one in front."""
        surface = self.surface
        text = b"".join([surface[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """Pieces of a long text, without the single blanks that part them; encoding them in turn encodes the text."""
    at = 0
    while at < len(text):
        end = at + size
        while 0 < end < len(text) and not (text[end] == " " and text[end - 1] not in (" ", MARK) and end + 1 < len(text) and text[end + 1] not in (" ", MARK)):
            end = text.find(" ", end + 1)
        end = end if 0 < end < len(text) else len(text)
        yield text[at:end]
        at = end + 1


def parts_of(text: str) -> list[bytes]:
    """The marked text, split before each marker that follows another character."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [p.encode() for p in PART.findall(MARK + text.replace(" ", MARK))]
    return [b"\xe2\x96\x81" + w for w in text.encode().split(b" ")]


def _encode_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        cache = pieces.encoder()
        is_byte = np.zeros(len(pieces.surface), bool)
        is_byte[pieces.byte[pieces.byte >= 0]] = True
        for batch in slices(batches, "text", SLICE):
            text = texts(batch.column("text"))
            ids = pieces.encode(text, cache)
            back = [pieces.decode(i) for i in ids]
            size = np.array([len(i) for i in ids])
            flat = np.concatenate(ids) if len(ids) else np.empty(0, np.int32)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat.astype(np.int32))),
                    "n_tokens": pa.array(size.astype(np.int64)),
                    "n_byte_tokens": pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    "lossless": pa.array([a == b for a, b in zip(text, back)], pa.bool_()),
                }
            )

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, n_byte_tokens, decoded_sha256 (of the text decoded from ids), lossless.

    Null text counts as empty and has no ids. Decoding gives the text back but where it has the marker itself, which becomes a
    space (``lossless`` is false then). Equal texts have equal ids; between segmentations of equal score the one whose last
    piece is longest stays; texts of any length are encoded whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))  # a few MB, by the vocabulary
    docs = id_text(docs, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, n_byte_tokens long, decoded_sha256 string, lossless boolean"
    return docs.mapInArrow(tidy(_encode_rows(shared)), schema)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of piece ids; null ids are the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(path))
    encoded = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [shared.value.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(text, pa.string())})

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
