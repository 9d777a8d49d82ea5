"""Secret scans over nested encodings.

Each text starts a worklist. A layer is scanned, then every encoded part of it is unwrapped into
further layers: percent escapes, ``\\u`` and ``\\x`` escapes, base64 (also over line breaks), and gzip or zlib data inside any of them. A part
is a layer alone, and the text around it with the parts of that encoding put in place is another. A layer keeps, for each of its characters, the place in the original text it comes from, so a secret
found at any depth is reported as a span of the original. Layers seen before (same text from the
same place) are not opened again, and the list runs until it is empty.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import contextlib
import hashlib
import itertools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices, tidy

KINDS = ("assign", "access", "hex")
#: The given patterns. A match that fails its length is dropped after it was consumed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this drops just what the length rule drops
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Runs without blanks and without a stray % or backslash, taken once each; those with an escape are unwrapped.
PERCENT = re.compile(r"(?:[^\s%]++|%[0-9A-Fa-f]{2})++")
ESCAPE = re.compile(r"(?:[^\s\\]++|\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]{1,6}\}))++")
ONE_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
ONE_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs over single line breaks, in either alphabet; indented lines too.
CHAINS = tuple(re.compile(rf"(?<![{c}])[{c}]++(?:\r?\n[ \t]*+[{c}]++)+={{0,2}}") for c in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Headers that compressed data have in practice; at the front of base64 any valid one counts.
PACKED, STEP, OUTPUT = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]"), 1024, 1 << 16
SEPARATOR, BASE64_PART = re.compile(r"[/_-]"), re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
#: A compressed layer is held as a whole up to so many bytes for each character of the text, or LAYER_LEAST if that is more. The rest of a larger one is
#: scanned as a stream (``Windows``); its spans are all of the compressed run, so it ends once it has given every kind.
LAYER_TIMES, LAYER_LEAST, WINDOW, SHARED = 64, 16 << 20, 1 << 22, 1 << 16
#: What ends a run in a stream, and what decodes one. An escape has ESCAPE_MOST bytes at most, a line break with its indentation GAP_MOST.
BLANKS, LINK = re.compile(rb"\s+"), re.compile(rb"(?<=[A-Za-z0-9+/_-])\r?\n[ \t]*(?=[A-Za-z0-9+/_-])")
NOT_BASE64, STANDARD = re.compile(rb"[^A-Za-z0-9+/_\-\r\n\t ]+"), bytes.maketrans(b"-_", b"+/")
PERCENT_BYTES, ESCAPE_BYTES = re.compile(rb"%([0-9A-Fa-f]{2})"), re.compile(rb"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\})")
ESCAPE_MOST, GAP_MOST = 10, 1024
SPACES = re.compile(rb" {2,}")

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """Base spans of one layer, ordered by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_odd: list[tuple[int, int]] = []


def _mark(error: UnicodeDecodeError) -> tuple[str, int]:
    _odd.append((error.start, error.end))
    return "\ufffd", error.end


codecs.register_error("sparkfolio.mark", _mark)


def _characters(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """UTF-8 bytes as text, with the source range of each character; bytes that are no UTF-8 become U+FFFD."""
    _odd.clear()
    text = raw.decode(errors="sparkfolio.mark")
    if len(text) != len(raw):
        first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        for a, b in _odd:
            first[a], first[a + 1 : b] = True, False
        lead = np.flatnonzero(first)
        begin, end = begin[lead], np.append(end[lead[1:] - 1], end[-1:])
    return text, begin, end


def _printable(text: str) -> bool:
    odd = sum(1 for c in text if c == "\ufffd" or not (c.isprintable() or c in "\n\r\t"))
    return odd * 20 <= len(text)


def _compressed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip or zlib data hold up to the first error, all members, STEP bytes of input and OUTPUT bytes of output at a time."""
    unpack, rest = zlib.decompressobj(47), b""
    for chunk in chunks:
        for at in range(0, len(chunk), STEP):
            piece = rest + bytes(chunk[at : at + STEP])
            rest = b""
            while piece:
                if unpack.eof:  # another member
                    if len(piece) < 3:
                        rest = piece
                        break
                    if not _compressed(piece):
                        return
                    unpack = zlib.decompressobj(47)
                try:
                    got = unpack.decompress(piece, OUTPUT)
                except zlib.error:
                    return
                if got:
                    yield got
                piece = unpack.unused_data if unpack.eof else unpack.unconsumed_tail


def _opens(head: bytes) -> bool:
    """Whether bytes begin like compressed data and give something."""
    if not _compressed(head):
        return False
    unpack = zlib.decompressobj(47)
    with contextlib.suppress(zlib.error):
        return any(unpack.decompress(bytes(head[at : at + STEP]), 1) for at in range(0, len(head), STEP))
    return False


def unpacked(raw: bytes, most: int) -> tuple[bytes | None, Iterator[bytes]]:
    """Bytes inside compressed bytes, through all their layers, about ``most`` of them; None if they are not compressed. (bytes, those that follow)"""
    if not _opens(raw):
        return None, iter(())
    chunks = inflate(iter([raw]))
    while True:
        head = b""
        while len(head) < STEP and (more := next(chunks, b"")):
            head += more
        chunks = itertools.chain([head], chunks)
        if not _opens(head):
            break
        chunks = inflate(chunks)
    out, size = [], 0
    for chunk in chunks:
        out.append(chunk)
        size += len(chunk)
        if size >= most:
            break
    return b"".join(out), chunks


class Inflating:
    """Passes on what gzip or zlib data hold as they come, all members, up to the first error."""

    def __init__(self, to: Layer) -> None:
        self.to, self.unpack, self.rest, self.alive = to, zlib.decompressobj(47), b"", True

    def feed(self, raw: bytes) -> None:
        for at in range(0, len(raw), STEP):
            piece, self.rest = self.rest + raw[at : at + STEP], b""
            while piece and self.alive:
                if self.unpack.eof:  # another member
                    if len(piece) < 3:
                        self.rest = piece
                        break
                    if not _compressed(piece):
                        self.alive = False
                        break
                    self.unpack = zlib.decompressobj(47)
                try:
                    got = self.unpack.decompress(piece, OUTPUT)
                except zlib.error:
                    self.alive = False
                    break
                self.to.feed(got)
                piece = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail

    def close(self) -> None:
        self.to.close()


class Layer:
    """Unpacked bytes: themselves compressed, or text."""

    def __init__(self, found: set[int]) -> None:
        self.found, self.head, self.to = found, b"", None

    def feed(self, raw: bytes) -> None:
        if self.to is None:
            self.head += raw
            if len(self.head) < STEP:
                return
            self._start()
        else:
            self.to.feed(raw)

    def _start(self) -> None:
        self.to = Inflating(Layer(self.found)) if _opens(self.head) else Windows(self.found)
        self.to.feed(self.head)

    def close(self) -> None:
        if self.to is None:
            self._start()
        self.to.close()


class Decoded:
    """Bytes of a decoded run: text, and data compressed from any place on."""

    def __init__(self, found: set[int]) -> None:
        self.found, self.text, self.packed, self.tail, self.begun = found, Windows(found), [], b"", False

    def feed(self, raw: bytes) -> None:
        for p in self.packed:
            p.feed(raw)
        view = self.tail + raw
        if len(view) < 3:
            self.tail = view
        else:
            starts = [m.start() for m in PACKED.finditer(view) if m.end() > len(self.tail) or not self.begun]
            if not self.begun and 0 not in starts and _compressed(view):
                starts.append(0)
            for at in starts:
                self.packed.append(Inflating(Layer(self.found)))
                self.packed[-1].feed(view[at:])
            self.begun, self.tail = True, view[-2:]
        ended = [p for p in self.packed if not p.alive]
        self.packed = [p for p in self.packed if p.alive]
        for p in [*ended]:
            p.close()
        self.text.feed(raw)

    def close(self) -> None:
        for p in self.packed:
            p.close()
        self.text.close()


class Base64Stream:
    """Base64 of a long run, over line breaks, at each of the four offsets. Windows have parts of up to SHARED characters whole, so only longer ones are decoded."""

    def __init__(self, found: set[int]) -> None:
        self.found, self.held, self.to = found, bytearray(), None

    def feed(self, piece: bytes) -> None:
        at = 0
        for m in NOT_BASE64.finditer(piece):
            self._take(piece[at : m.start()])
            self.close()
            at = m.end()
        self._take(piece[at:])

    def _take(self, part: bytes) -> None:
        part = part.translate(STANDARD, b"\r\n\t ")
        if self.to is None:
            self.held += part
            if len(self.held) <= SHARED:
                return
            part, self.held = bytes(self.held), bytearray()
            self.to = [[part[off:off], Decoded(self.found)] for off in range(4)]
            pieces = [part[off:] for off in range(4)]
        else:
            pieces = [part] * 4
        for state, piece in zip(self.to, pieces):
            whole = state[0] + piece
            cut = len(whole) // 4 * 4
            state[0] = whole[cut:]
            state[1].feed(base64.b64decode(whole[:cut]))

    def close(self) -> None:
        for rest, to in self.to or ():
            to.feed(base64.b64decode(rest + b"=" * (-len(rest) % 4)) if len(rest) > 1 else b"")
            to.close()
        self.held, self.to = bytearray(), None


class EscapeStream:
    """A long run with its escapes of one kind taken out, from SHARED bytes before the first on."""

    def __init__(self, found: set[int], one: re.Pattern, lead: bytes) -> None:
        self.found, self.one, self.lead, self.rest, self.to = found, one, lead, b"", None

    def feed(self, piece: bytes, last: bool = False) -> None:
        whole = self.rest + piece
        if self.to is None:
            if not self.one.search(whole):
                self.rest = whole[-SHARED:]
                return
            self.to = Decoded(self.found)
        cut = whole.rfind(self.lead, max(0, len(whole) - ESCAPE_MOST))  # an escape may go on in the next piece
        cut = len(whole) if last or cut < 0 else cut
        self.rest = whole[cut:]
        self.to.feed(self.one.sub(_escaped, whole[:cut]))

    def close(self) -> None:
        self.feed(b"", True)
        if self.to is not None:
            self.to.close()


def _escaped(m: re.Match) -> bytes:
    code = int(next(filter(None, m.groups())), 16)
    return bytes([code]) if code < 256 else chr(code).encode(errors="replace") if code < 0x110000 else b"?"


def _gaps(held: bytes, first: int, last: int) -> Iterator[re.Match]:
    """Blanks that begin in a range and end a run: all but single line breaks between base64 characters."""
    for m in BLANKS.finditer(held, max(0, first - GAP_MOST)):
        if m.start() >= last:
            return
        link = LINK.match(held, m.start())
        if m.start() >= first and not (link and link.end() == m.end()):
            yield m


def _run_start(held: bytes, at: int) -> int:
    """Where the run that goes on at a place begins."""
    while at > 0:
        low = max(0, at - SHARED)
        ends = [m.end() for m in _gaps(held, low, at)]
        if ends:
            return ends[-1]
        at = low
    return 0


class Windows:
    """Kinds of secrets in bytes of any number, window by window.

    Windows have SHARED bytes in common. A run without blanks that a window cuts is carried over; one of over half a window is decoded as it comes, so memory is bounded and no run is seen in parts only.
    """

    def __init__(self, found: set[int]) -> None:
        self.found, self.held, self.run, self.given = found, bytearray(), [], 0

    def feed(self, chunk: bytes) -> None:
        self.held += chunk
        if len(self.held) >= WINDOW and len(self.found) < len(KINDS):
            self._squeeze()
            if len(self.held) >= WINDOW:
                self._look()
        elif len(self.held) >= WINDOW:
            self.held.clear()

    def _squeeze(self) -> None:
        """Patterns take any number of spaces; a run's bytes that went to its decoders stay as they are."""
        self.held[self.given :] = SPACES.sub(b" ", self.held[self.given :])

    def _look(self, last: bool = False) -> None:
        held = bytes(self.held)
        self.found |= {k for _, k, _ in deep_scan(held.decode(errors="replace"))[1]}
        keep = max(0, len(held) - SHARED)
        if self.run:
            self._pass_on(held, last)
        if not self.run and not last:
            start = min(keep, _run_start(held, keep))
            if len(held) - start > WINDOW // 2:
                self.run = [Base64Stream(self.found), EscapeStream(self.found, PERCENT_BYTES, b"%"), EscapeStream(self.found, ESCAPE_BYTES, b"\\")]
                self.given = start
                self._pass_on(held, last)
            else:
                keep = start
        self.held = bytearray(held[keep:])
        self.given = max(0, self.given - keep) if self.run else 0

    def _pass_on(self, held: bytes, last: bool) -> None:
        begin = self.given
        end = len(held) if last else max(begin, len(held) - GAP_MOST)  # blanks after it may go on
        gap = next(_gaps(held, begin, end), None)
        self.given = gap.start() if gap else end
        for to in self.run:
            to.feed(held[begin : self.given])
        if gap or last:
            for to in self.run:
                to.close()
            self.run = []

    def close(self) -> None:
        if len(self.found) < len(KINDS):
            self._squeeze()
            self._look(True)
        self.held.clear()


def kinds_of(chunks: Iterator[bytes]) -> set[int]:
    """Kinds of secrets in bytes of any number; ends once it has all."""
    found: set[int] = set()
    to = Windows(found)
    for chunk in chunks:
        to.feed(bytes(chunk))
        if len(found) == len(KINDS):
            break
    to.close()
    return found


def _packed(raw: bytes, first: int, last: int, most: int) -> list:
    """The layer of compressed data, all of it from source ``first`` to ``last``, and if it has more than ``most`` bytes, the kinds in the rest."""
    inner, rest = unpacked(raw, most)
    if inner is None:
        return []
    text = inner.decode(errors="replace")
    out = [(text, np.full(len(text), first), np.full(len(text), last))]
    more = next(rest, None)
    if more is not None:
        held = SPACES.sub(b" ", inner)
        held = held[min(len(held), _run_start(held, max(0, len(held) - SHARED))) :]
        out.append((kinds_of(itertools.chain((held[at : at + OUTPUT] for at in range(0, len(held), OUTPUT)), [more], rest)), first, last))
    return out


def packed_layers(raw: bytes, begin: np.ndarray, end: np.ndarray, most: int) -> list:
    """Layers of compressed data anywhere in bytes; each covers the source from its first byte on."""
    out, view = [], memoryview(raw)
    for m in PACKED.finditer(raw):
        out += _packed(view[m.start() :], begin[m.start()], end[-1], most)
    return out


def percent_bytes(part: str, at: int):
    raw, begin, end, i = bytearray(), [], [], 0

    def plain(a: int, b: int) -> None:
        code = part[a:b].encode(errors="replace")
        raw.extend(code)
        place = range(a, b)
        if len(code) > b - a:
            place = (np.cumsum((np.frombuffer(code, np.uint8) & 0xC0) != 0x80) + a - 1).tolist()
        begin.extend(place)
        end.extend(p + 1 for p in place)

    for m in ONE_PERCENT.finditer(part):
        plain(i, m.start())
        raw.append(int(m[1], 16))
        begin.append(m.start())
        end.append(m.end())
        i = m.end()
    plain(i, len(part))
    return bytes(raw), np.array(begin, np.int64) + at, np.array(end, np.int64) + at


def escape_layer(part: str, at: int):
    """Two escapes that are halves of a surrogate pair are one character; a half alone is U+FFFD."""
    chars, begin, end, i, high = [], [], [], 0, None
    for m in ONE_ESCAPE.finditer(part):
        code = int(m[1] or m[2] or m[3], 16)
        if high is not None and m.start() == i and 0xDC00 <= code < 0xE000:
            chars[-1] = chr(0x10000 + (high - 0xD800 << 10) + code - 0xDC00)
            end[-1], i, high = m.end(), m.end(), None
            continue
        chars += part[i : m.start()]
        begin += range(i, m.start())
        end += range(i + 1, m.start() + 1)
        high = code if 0xD800 <= code < 0xDC00 else None
        chars.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
        begin.append(m.start())
        end.append(m.end())
        i = m.end()
    chars += part[i:]
    begin += range(i, len(part))
    end += range(i + 1, len(part) + 1)
    return "".join(chars), np.array(begin, np.int64) + at, np.array(end, np.int64) + at


def base64_layers(part: str, place: np.ndarray, most: int) -> list:
    """Layers of a base64 run whose characters lie at ``place``: its text, and what is compressed in it."""
    body = part.rstrip("=")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        raw = base64.b64decode(body.translate({45: 43, 95: 47}) + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return []
    if not raw:
        return []
    byte = np.arange(len(raw))
    begin, end = place[byte * 4 // 3], place[np.minimum(-(-(byte + 1) * 4 // 3), len(part)) - 1] + 1
    return _packed(raw, int(place[0]), int(place[-1]) + 1, most) or [_characters(raw, begin, end), *packed_layers(raw, begin, end, most)]


def wrapped_runs(layer: str) -> Iterator[np.ndarray]:
    """Places of base64 characters in runs over single line breaks: each whole chain of lines, and the blocks of equal width in it."""
    for chain in CHAINS:
        for m in chain.finditer(layer):
            lines = [(x.start(), x.end()) for x in LINE.finditer(layer, m.start(), m.end())]
            size = [b - a for a, b in lines]
            if max(size) < 16:
                continue
            blocks, i = {(0, len(lines))}, 0
            for i in range(len(lines) - 1):
                if i and size[i] == size[i - 1]:
                    continue
                j = i + 1  # lines after the first are of one width, and the last is no wider
                while j + 1 < len(lines) and size[j + 1] == size[i + 1]:
                    j += 1
                blocks.add((i, min(len(lines), j + 1 + (j + 1 < len(lines) and size[j + 1] < size[i + 1]))))
            for a, b in sorted(blocks):
                yield np.concatenate([np.arange(*x) for x in lines[a:b]])


def in_place(layer: str, parts: list) -> tuple[str, np.ndarray, np.ndarray]:
    """The layer with decoded parts (start, end, inner) in their places."""
    text, first, last, i = [], [], [], 0
    for a, b, inner in [*sorted(parts, key=lambda p: (p[0], -p[1])), (len(layer), len(layer), None)]:
        if a < i:
            continue
        text.append(layer[i:a])
        first.append(np.arange(i, a))
        last.append(np.arange(i + 1, a + 1))
        if inner:
            text.append(inner[0])
            first.append(inner[1])
            last.append(inner[2])
        i = b
    return "".join(text), np.concatenate(first), np.concatenate(last)


def _readable(inner: list) -> bool:
    return bool(inner) and _printable(inner[0][0])


def opened_layers(layer: str, most: int) -> list:
    """Everything that unwraps from a layer: each part alone, and per encoding the layer with those parts in place.

    An entry is (text, first, last) by character, or (kinds, first, last) of what a compressed layer holds beyond ``most`` bytes.
    """
    out, views = [], []
    if "%" in layer:
        view = []
        for m in PERCENT.finditer(layer):
            if "%" in m[0]:
                raw, begin, end = percent_bytes(m[0], m.start())
                out += packed_layers(raw, begin, end, most)
                view.append((*m.span(), _characters(raw, begin, end)))
        views.append(view)
    if "\\" in layer:
        view = []
        for m in ESCAPE.finditer(layer):
            if "\\" in m[0]:
                part = escape_layer(m[0], m.start())
                out += packed_layers(part[0].encode("latin-1", "replace"), *part[1:], most)
                view.append((*m.span(), part))
        views.append(view)
    runs = [np.arange(*m.span()) for m in BASE64.finditer(layer)]
    for places in (runs, wrapped_runs(layer) if "\n" in layer else ()):
        view = []
        for place in places:
            a, b = int(place[0]), int(place[-1]) + 1
            run = layer[a:b] if b - a == len(place) else "".join(layer[i] for i in place.tolist())
            inner = base64_layers(run, place, most)
            out += inner
            if _readable(inner):
                view.append((a, b, inner[0]))
                continue
            if SEPARATOR.search(run):  # of a path or a name: its parts may be base64
                for x in BASE64_PART.finditer(run):
                    out += base64_layers(x[0], place[x.start() : x.end()], most)
            for off in (1, 2, 3):  # glued to a prefix of other length
                some = base64_layers(run[off:], place[off:], most)
                out += some if _readable(some) else some[1:]
        views.append(view)
    for view in filter(None, views):
        out += [inner for *_, inner in view]
        out.append(in_place(layer, view))
    return out


def deep_scan(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and the number of layers unwrapped."""
    base = scan(text)
    found, seen, layers = set(base), set(), 0
    most = max(LAYER_LEAST, LAYER_TIMES * len(text))
    work = deque([(text, None, None)])
    while work:
        layer, begin, end = work.popleft()
        for inside, first, last in opened_layers(layer, most):
            if isinstance(inside, set):
                a, b = (first, last) if begin is None else (int(begin[first]), int(end[last - 1]))
                found.update((a, kind, b) for kind in inside)
                continue
            if not inside or inside == layer:
                continue
            if begin is not None:
                first, last = begin[first], end[last - 1]
            key = (inside, int(first[0]), int(last[-1]))
            if key in seen:
                continue
            seen.add(key)
            layers += 1
            found.update((int(first[a]), kind, int(last[b - 1])) for a, kind, b in scan(inside))
            work.append((inside, first, last))
    return base, sorted(found), layers


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out = [deep_scan(t or "") for t in batch.column("text").to_pylist()]
        count = {f"n_{k}": pa.array([sum(s[1] == i for s in base) for base, *_ in out], pa.int64()) for i, k in enumerate(KINDS)}
        yield pa.record_batch(
            {"doc_id": batch.column("doc_id")}
            | count
            | {
                "base_sha256": pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, *_ in out], pa.string()),
                "spans": pa.array([joined(spans) for _, spans, _ in out], pa.string()),
                "n_layers": pa.array([n for *_, n in out], pa.int64()),
            }
        )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans, n_layers.

    Spans count code points of the original text, end exclusive. A span found in a decoded layer
    covers the encoded characters it was decoded from (all of the run where that was compressed). Null text counts as empty and has no
    spans; a text of any length is scanned whole; equal texts have equal values; an empty table gives no rows.
    """
    docs = id_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(_rows), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")
