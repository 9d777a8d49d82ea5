import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import sentencepiece as S

VOCAB = ["▁", "▁▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab", "é", "▁é", "aé", "abab", "c"]


def toy(with_bytes=True):
    rng = random.Random(1)
    pieces = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + [(p, -rng.uniform(1, 9)) for p in VOCAB]
    if with_bytes:
        return S.Pieces.of(pieces, {b: b + 1 for b in range(256)}, {0})
    return S.Pieces.of([pieces[0], *pieces[257:]], {}, {0})


def best_score(pieces, part):
    """By dynamic programming over substrings."""
    known = {p: s for p, s in zip(pieces.surface, pieces.score) if p}
    plain = {p: s for i, (p, s) in enumerate(zip(pieces.surface, pieces.score)) if p and i not in set(pieces.byte.tolist())}
    assert known
    score = [0.0] + [-1e18] * len(part)
    for e in range(1, len(part) + 1):
        for b in range(e):
            chunk = part[b:e]
            s = plain.get(chunk, -1e18)
            try:
                if len(chunk.decode()) == 1:
                    s = max(s, pieces.least * len(chunk))
            except UnicodeDecodeError:
                pass
            score[e] = max(score[e], score[b] + s)
    return score[-1]


def score_of(pieces, ids):
    in_bytes = set(pieces.byte.tolist())
    return sum(pieces.least if i in in_bytes else float(pieces.score[i]) for i in ids)


texts = st.text(alphabet="ab cé▁xß\n", max_size=40)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_segmentation_is_the_best_one(text):
    pieces = toy()
    for part in S.parts_of(text):
        one = pieces.viterbi(part)
        assert score_of(pieces, one) == pytest.approx(best_score(pieces, part))
        assert pieces.viterbi_all([part]) == [one]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_decoding_gives_the_text_back(text):
    pieces = toy()
    assert pieces.decode(pieces.encode([text])[0]) == text.replace("▁", " ")


def test_without_byte_pieces_a_character_is_unknown():
    pieces = toy(False)
    assert pieces.unknown in pieces.encode(["aßb"])[0].tolist()


def test_trie_holds_just_its_keys():
    rng = random.Random(2)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5))): i for i in range(2000) for _ in [0]}
    keys = {k: i for i, k in enumerate(keys)}
    trie = S.DoubleArray.build(keys)

    def find(word):
        state = 0
        for b in word:
            to = trie.base[state] + b + 1
            if trie.check[to] != state:
                return -1
            state = to
        return trie.value[state]

    assert all(find(k) == i for k, i in keys.items())
    assert all(find(k + b"\0") == keys.get(k + b"\0", -1) for k in keys)


def test_model_file_round_trip(spark, documents):
    rows = S.encode_documents(documents).collect()
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in S.decode_documents(S.encode_documents(documents)).collect()}
    assert back == {r["doc_id"]: r["text"] for r in documents.collect()}


def test_long_text_without_blanks():
    pieces = S.Pieces.load()
    text = "abcdéß" * 3000
    assert pieces.decode(pieces.encode([text])[0]) == text
