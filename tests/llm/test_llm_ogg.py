import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import ogg as O


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
def test_checksum(data):
    assert O.page_crc(data) == slow_crc(data)


packets = st.lists(st.binary(max_size=900), min_size=1, max_size=12)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 2**32 - 1), packets, min_size=1, max_size=3), st.integers(1, 255))
def test_packets_survive_any_paging(streams, segments):
    timed = {s: [(p, i * 10) for i, p in enumerate(ps)] for s, ps in streams.items()}
    back = O.demux(O.mux(timed, segments))
    assert not back.bad_pages
    assert {s: [p.data for p in x.packets] for s, x in back.streams.items()} == streams
    for s, x in back.streams.items():
        assert x.ended and all(p.granule in (None, i * 10) for i, p in enumerate(x.packets))


@pytest.mark.parametrize("size", [0, 1, 255, 510, 65025, 65026, 200_000])
def test_packets_at_the_lacing_limits(size):
    data = bytes(i % 251 for i in range(size))
    back = O.demux(O.mux({1: [(b"head", 0), (data, 7), (b"tail", 9)]}))
    assert [p.data for p in back.streams[1].packets] == [b"head", data, b"tail"]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_payload_round_trip(raw):
    payload = O.pad(raw)
    assert len(payload) % O.FRAME == 0 and payload.startswith(raw) and set(payload[len(raw) :]) <= {255}
    track = O.load(O.store(payload))
    assert track.payload == payload and track.samples == len(payload) and track.streams == 2


def test_damage_is_noticed():
    media = bytearray(O.store(O.pad(b"x" * 200_000)))
    media[100_000] ^= 1
    back = O.demux(bytes(media))
    assert back.bad_pages == 1 and sum(s.lost for s in back.streams.values()) == 1
    with pytest.raises(O.OggError):
        O.load(bytes(media))
    with pytest.raises(O.OggError):
        O.load(bytes(media[: len(media) // 2]))


def test_times_between_stated_positions():
    found = [O.Packet(b"a"), O.Packet(b"b", 20), O.Packet(b"c"), O.Packet(b"d")]
    assert O.packet_ends(found, [10, 10, 10, 5]) == [10, 20, 30, 35]


def test_digest_is_of_what_was_read_back():
    text = "Ein Text, é " * 100
    n, padded, sha, tail, size, media_sha, feature = O.digest(text)
    payload = O.pad(text.encode())
    assert (n, padded, sha) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest())
    assert tail == zlib.crc32(payload[-32:]) and size == len(O.store(payload)) and "streams=2" in feature
    assert O.digest(None) == O.digest("")


def test_media_column(make):
    row = O.ogg_media(make([(1, "hello")])).first()
    assert O.load(bytes(row["media"])).payload == O.pad(b"hello")
