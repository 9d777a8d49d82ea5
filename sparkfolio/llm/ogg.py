"""Ogg media columns: page checksums, packet reassembly, demultiplexing and granule timestamps.

``mux`` writes logical streams as interleaved pages, ``demux`` reads any such bytes back. A payload is
stored as 8-bit samples in frames of 576, even frames in one logical stream and odd frames in
a second, so that reading it back needs every one of those steps.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices

FRAME = 576
RATE = 8000
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
#: First packet of each of our streams: magic, sample rate, frame length, index and count of streams.
IDENT = struct.Struct("<8sIHBB")
MAGIC = b"\x7fSAMPLE8"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """Bytes that are not the complete stream asked for."""


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, high bit first, start and end 0: zlib's, seen in a mirror."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]], segments: int = 255) -> Iterator[bytes]:
    """Pages of one logical stream of (packet, granule position at its end); the first packet has a page of its own."""
    number, lacing, body, granule, kind = 0, bytearray(), bytearray(), -1, FIRST
    for i, (packet, end) in enumerate(packets):
        full, rest = divmod(len(packet), 255)
        values, at = b"\xff" * full + bytes((rest,)), 0
        while True:
            room = segments - len(lacing)
            part = values[:room]
            lacing += part
            size = sum(part)
            body += packet[at : at + size]
            at, values = at + size, values[room:]
            if not values:
                granule = end
                break
            yield _page(kind, granule, serial, number, bytes(lacing), bytes(body))
            number, lacing, body, granule, kind = number + 1, bytearray(), bytearray(), -1, CONTINUED if at else 0
        last = i == len(packets) - 1
        if last or i == 0 or len(lacing) == segments:
            yield _page(kind | LAST * last, granule, serial, number, bytes(lacing), bytes(body))
            number, lacing, body, granule, kind = number + 1, bytearray(), bytearray(), -1, 0


def mux(streams: dict[int, list[tuple[bytes, int]]], segments: int = 255) -> bytes:
    """First pages of all streams, then the others in turn."""
    out, live = [], [stream_pages(s, packets, segments) for s, packets in streams.items()]
    while live:
        rest = []
        for pages in live:
            page = next(pages, None)
            if page is not None:
                out.append(page)
                rest.append(pages)
        live = rest
    return b"".join(out)


@dataclass
class Packet:
    data: bytes
    #: Granule position at the packet's end, where its page states it.
    granule: int | None = None


@dataclass
class Stream:
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    lost: int = 0
    _next: int = 0
    _open: bytearray | None = None


@dataclass
class Ogg:
    streams: dict[int, Stream] = field(default_factory=dict)
    bad_pages: int = 0


def demux(data: bytes) -> Ogg:
    """Logical streams and their packets. Pages with a wrong checksum are counted and left out, and a packet that lost a part is dropped."""
    ogg, at, n = Ogg(), 0, len(data)
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > n:
            ogg.bad_pages += 1
            break
        _, version, kind, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if version or len(lacing) < count or end > n or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            ogg.bad_pages += 1
            at += 4
            continue
        stream = ogg.streams.setdefault(serial, Stream())
        if number != stream._next:
            stream.lost += max(1, number - stream._next)
            stream._open = None
        stream._next, stream.pages, stream.ended = number + 1, stream.pages + 1, stream.ended or bool(kind & LAST)
        if kind & CONTINUED:
            skip = stream._open is None
            part = bytearray() if skip else stream._open
        else:
            skip, part = False, bytearray()
        stream._open = None
        pos, size, complete, done = at + 27 + count, 0, None, True
        for value in lacing:
            size += value
            done = value < 255
            if done:
                if not skip:
                    complete = Packet(bytes(part) + data[pos : pos + size] if part else data[pos : pos + size])
                    stream.packets.append(complete)
                pos, size, skip, part = pos + size, 0, False, bytearray()
        if not done:
            stream._open = None if skip else part + data[pos : pos + size]
        if complete is not None and granule >= 0:
            complete.granule = granule
        at = end
    return ogg


def packet_ends(packets: list[Packet], lengths: list[int]) -> list[int]:
    """End of each packet in samples: stated positions, and counted from the nearest stated one, later ones first, for the others."""
    ends: list[int | None] = [p.granule for p in packets]
    for i in range(len(ends) - 2, -1, -1):
        if ends[i] is None and ends[i + 1] is not None:
            ends[i] = ends[i + 1] - lengths[i + 1]
    for i in range(len(ends)):
        if ends[i] is None:
            ends[i] = (ends[i - 1] if i else 0) + lengths[i]
    return ends


def pad(raw: bytes) -> bytes:
    """``raw`` and bytes 255 up to a positive multiple of a frame."""
    return raw + b"\xff" * (FRAME * max(1, -(-len(raw) // FRAME)) - len(raw))


def store(payload: bytes) -> bytes:
    """An Ogg file of a payload of whole frames. Serials come from the payload, so equal payloads give equal files."""
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    streams = {}
    for k in (0, 1):
        starts = range(k * FRAME, len(payload), 2 * FRAME)
        frames = [(payload[a : a + FRAME], (i + 1) * FRAME) for i, a in enumerate(starts)]
        streams[serial | k] = [(IDENT.pack(MAGIC, RATE, FRAME, k, 2), 0), *frames]
    return mux(streams)


@dataclass
class Track:
    payload: bytes
    pages: int
    streams: int
    packets: int
    samples: int
    seconds: float


def load(media: bytes) -> Track:
    """The payload of a file of ``store`` and what its pages say; raises OggError if any part is lost."""
    ogg = demux(media)
    if ogg.bad_pages or not ogg.streams or any(s.lost or not s.ended for s in ogg.streams.values()):
        raise OggError("a page is damaged or missing")
    parts: dict[int, list[bytes]] = {}
    last, pages, packets = 0.0, 0, 0
    samples = 0
    for stream in ogg.streams.values():
        magic, rate, frame, index, count = IDENT.unpack(stream.packets[0].data)
        if magic != MAGIC or count != len(ogg.streams):
            raise OggError("not one of our streams")
        body = stream.packets[1:]
        ends = packet_ends(body, [len(p.data) for p in body])
        order = sorted(range(len(body)), key=ends.__getitem__)
        parts[index] = [body[i].data for i in order]
        samples += ends[order[-1]] if order else 0
        last = max(last, (ends[order[-1]] if order else 0) / rate)
        pages, packets = pages + stream.pages, packets + len(stream.packets)
    whole = [parts[k][i] for i in range(len(parts[0])) for k in sorted(parts) if i < len(parts[k])]
    return Track(b"".join(whole), pages, len(parts), packets, samples, last)


def digest(text: str | None) -> tuple:
    """Values of one text: it is stored, the stored bytes are read back, and all is computed from those."""
    raw = (text or "").encode()
    media = store(pad(raw))
    track = load(media)
    read = track.payload
    feature = f"streams={track.streams};pages={track.pages};packets={track.packets};samples={track.samples};seconds={track.seconds:.3f};mean={sum(read) / len(read):.3f}"
    return len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


FIELDS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_TYPES = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def _rows(with_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text = batch.column("text").to_pylist()
            if with_media:
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "media": pa.array([store(pad((t or "").encode())) for t in text], pa.binary())})
                continue
            columns = zip(*map(digest, text))
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.string() if _TYPES[k] == "string" else pa.int64()) for k, v in zip(FIELDS, columns)})

    return run


def ogg_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``media``, the text's bytes as an Ogg file. Null text counts as empty and gives one frame of bytes 255."""
    docs = id_text(docs, id_col, text_col)
    return docs.mapInArrow(_rows(True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def ogg_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the values of ``digest``. Equal texts have equal values; null text counts as empty; an empty table gives no rows."""
    docs = id_text(docs, id_col, text_col)
    return docs.mapInArrow(_rows(False), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {_TYPES[k]}" for k in FIELDS))
