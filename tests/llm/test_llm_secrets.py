import base64
import gzip
import re
import time
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import secrets as S


def brute(text):
    """Base spans by the patterns as given."""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


parts = st.sampled_from(["password", "PassWd", "secret", "toKen", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "0123456789abcdef", "AKIA", "ABCD1234EFGH", "é", "ſecret", "K", "%41", "\\u0041", "\n", "-"])


@settings(max_examples=300, deadline=None)
@given(st.lists(parts, max_size=30).map("".join))
def test_base_spans_are_those_of_the_patterns_and_stay(text):
    base, spans, _ = S.deep_scan(text)
    assert base == brute(text)
    assert set(base) <= set(spans)


SECRET = 'password = "hunter2hunter2"'
WRAPS = {
    "url": lambda s: quote(s, safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "hex escapes": lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "base64 for urls": lambda s: base64.urlsafe_b64encode(("??>>" + s).encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(),
    "zlib": lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    "zlib twice": lambda s: base64.b64encode(zlib.compress(gzip.compress(s.encode(), mtime=0))).decode(),
}


@pytest.mark.parametrize("inner", WRAPS)
@pytest.mark.parametrize("outer", [None, *WRAPS])
def test_wrapped_secrets_are_found_within_their_wrapping(inner, outer):
    wrapped = WRAPS[inner](SECRET)
    if outer:
        wrapped = WRAPS[outer](wrapped)
    text = f"some text. {wrapped} and on"
    base, spans, layers = S.deep_scan(text)
    assert not base and layers >= 1
    assert any(k == 0 and 11 <= a < b <= 11 + len(wrapped) for a, k, b in spans)


def test_spans_are_mapped_to_what_encodes_them():
    text = "é " + base64.b64encode("äö token=abcdefgh99 äö".encode()).decode()
    ((a, k, b),) = S.deep_scan(text)[1]
    assert k == 0 and b"token=abcdefgh99" in base64.b64decode(text[2:])[(a - 2) * 3 // 4 - 3 :] and 2 < a < b < len(text)
    text = "x=1&%74oken%3Dabcdefgh1"
    ((a, k, b),) = S.deep_scan(text)[1]
    assert text[a:b] == "%74oken%3Dabcdefgh1"


def test_a_layer_that_unwraps_to_itself_ends():
    assert S.deep_scan("%25" * 50 + "41")[2] >= 2
    nested = "secret: abcdefgh1"
    for _ in range(12):
        nested = base64.b64encode(nested.encode()).decode()
    assert S.deep_scan(nested)[1]


def test_large_compressed_layers_go_in_windows(monkeypatch):
    for name, value in {"LAYER_LEAST": 1000, "LAYER_TIMES": 0, "WINDOW": 5000, "SHARED": 100}.items():
        monkeypatch.setattr(S, name, value)
    bomb = lambda raw: base64.b64encode(raw).decode()
    assert S.deep_scan(bomb(zlib.compress(b" " * 10_000_000)))[1] == []
    for at in (10, 990, 4990, 5050, 299_980):
        raw = bytearray(b". " * 150_000)
        raw[at : at + 18] = b'"token" : abcdefgh'
        for text in (bomb(zlib.compress(raw)), bomb(gzip.compress(zlib.compress(raw))), bomb(gzip.compress(raw[:100_000]) + gzip.compress(raw[100_000:]))):
            assert S.deep_scan(text)[1] == [(0, 0, len(text))], at
    raw = b". " * 30_000 + b"token" + b" " * 20_000 + b"= abcdefgh" + b". " * 10_000
    assert {k for _, k, _ in S.deep_scan(bomb(zlib.compress(raw)))[1]} == {0}


def test_long_tokens_take_linear_time():
    for text in ("a" * 1_000_000 + "%41", "b1" * 500_000 + "\\x41", "%41" * 300_000 + " token%3Dabcdefgh1"):
        begin = time.process_time()
        S.deep_scan(text)
        assert time.process_time() - begin < 20


def test_pairs_of_escapes_and_glued_base64():
    assert S.escape_layer("a\\ud83d\\ude00\\ud83db", 5)[0] == "a\U0001f600\ufffdb"
    assert S.escape_layer("a\\ud83d\\ude00b", 5)[2].tolist() == [6, 18, 19]
    assert found('"\\ud83d\\ude00 p\\u0061ssword=\\u0061bcdefgh1"')
    coded = base64.b64encode(b"the token=abcdefgh99 is here").decode()
    for prefix in ("x", "xy", "xyz", "xyzw"):
        assert found(prefix + coded), prefix


def found(text):
    return [text[a:b] for a, k, b in S.deep_scan(text)[1] if k == 0]


def test_secrets_that_lie_in_part_outside_the_encoded_run():
    assert found('{"password": "\\u0068unter2hunter2"}') == ['password": "\\u0068unter2hunter2']
    assert found("token = abc%64efgh1234") == ["token = abc%64efgh1234"]
    value = base64.b64encode(b"hunter2hunter2").decode().rstrip("=")
    assert f"token :  {value}" in found(f"token :  {value}")
    assert found('secret = "%5Cu0061bcdefgh%31"') == ['secret = "%5Cu0061bcdefgh%31']


@pytest.mark.parametrize("pack", [bytes, lambda raw: gzip.compress(raw, mtime=0), zlib.compress])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
def test_base64_over_line_ends(pack, end):
    inside = "".join(chr(33 + i * i % 89) for i in range(50)) + " token=" + "Abcdefgh12" * 5 + " " + "".join(chr(33 + i * i * i % 89) for i in range(90))
    coded = base64.b64encode(pack(inside.encode())).decode()
    wrapped = end.join(coded[i : i + 76] for i in range(0, len(coded), 76))
    for text in (wrapped, f"-----BEGIN CERTIFICATE-----\n{wrapped}\n-----END", f"somewhere\nelse\n{wrapped}\nand on"):
        spans = S.deep_scan(text)[1]
        assert any(k == 0 and (pack is not bytes or b - a >= 76) for a, k, b in spans), text


def test_layers_that_are_partly_no_text():
    coded = lambda raw: base64.b64encode(raw).decode()
    for text in (
        coded(b"x token=abcdefgh99"),
        coded(zlib.compress(b"x token=abcdefgh99")),
        coded(b"x^ token=abcdefgh99"),
        coded(bytes(range(128, 160)) + b" token=abcdefgh99 "),
        coded(b"\0\1\2\3\4\5\6" + b" token=abcdefgh99"),
        coded(zlib.compress(b"token=abcdefgh99 " + bytes(range(256)) * 30)[:-40] + b"\xff" * 40),
    ):
        assert S.deep_scan(text)[1], text
    assert found("/?q=caf%E9&token%3Dabcdefgh1") == ["token%3Dabcdefgh1"]
    for raw in (gzip.compress(b"token=abcdefgh99", mtime=0), zlib.compress(b"token=abcdefgh99")):
        assert found("data=" + quote(raw)) and found('b"' + "".join(f"\\x{c:02x}" for c in raw) + '"')


def packed_long(inner: bytes, filler: int = 40_000) -> str:
    """A compressed run that holds ``inner`` past the part that is held as a whole."""
    return base64.b64encode(zlib.compress(b"some words " * filler + inner + b" some words" * 20_000, 9)).decode()


@pytest.fixture
def small_windows(monkeypatch):
    for name, value in {"LAYER_TIMES": 1, "LAYER_LEAST": 1 << 16, "WINDOW": 1 << 15, "SHARED": 1 << 11}.items():
        monkeypatch.setattr(S, name, value)


@pytest.mark.parametrize("size", [1_000, 30_000, 200_000])
@pytest.mark.parametrize("kind", ["gzip", "twice", "wrapped", "plain", "glued", "percent", "escape", "at the cut"])
def test_long_runs_in_large_layers_are_found_at_any_length(small_windows, kind, size):
    noise = np.random.default_rng(5).integers(33, 90, size, np.uint8).tobytes().replace(b"%", b"!").replace(b"=", b"!").replace(b":", b"!")
    secret = noise + b" token=abcdefgh99 " + noise[: size // 2]
    coded = base64.b64encode(gzip.compress(secret, 1))
    inner, filler = {
        "gzip": (coded, 40_000),
        "twice": (base64.b64encode(zlib.compress(b"x" * 90_000 + b" " + coded)), 40_000),
        "wrapped": (b"\r\n".join(coded[i : i + 76] for i in range(0, len(coded), 76)), 40_000),
        "plain": (base64.b64encode(secret), 40_000),
        "glued": (b"name." + b"ab/" * 2 + coded, 40_000),
        "percent": (noise + quote(noise.decode()).encode() + b"token%3Dabcdefgh99", 40_000),
        "escape": (noise.replace(b"A", b"\\x41") + b"t\\u006fken=abcdefgh99", 40_000),
        "at the cut": (coded, (1 << 16) // 11),
    }[kind]
    assert {k for _, k, _ in S.deep_scan(packed_long(inner, filler))[1]} == {0}


def test_runs_in_large_layers_without_secrets_give_none(small_windows):
    noise = bytes(np.random.default_rng(6).integers(33, 58, 300_000, np.uint8)).replace(b"=", b"!").replace(b":", b"!")
    for inner in (noise, base64.b64encode(noise), quote(noise.decode()).encode(), b"\0" * 500_000, b"A" * 500_000):
        assert S.deep_scan(packed_long(inner))[1] == []
