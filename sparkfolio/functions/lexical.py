"""English full-text search: tokens, stop words, stems, position vectors, matching and rank.

The stemmer follows the published English (Porter2) algorithm. The tokenizer knows words, numbers and
hyphenated words with their parts, not urls, hosts, mail addresses or file names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .positions import RANK_DIGITS, ranks, ranks_of_places

#: English stop words of full-text search.
STOP = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now
    """.split()
)
TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*(?:'[^\W_]+)?")
MOST_POSITION, MOST_POSITIONS = 16383, 256

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
#: Fixed values of the stemmer: whole-word exceptions, and suffix replacements of steps 2 to 4.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Place after the first consonant that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWEL and word[i - 1] in _VOWEL:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    return len(word) > 2 and word[-3] not in _VOWEL and word[-2] in _VOWEL and word[-1] not in _VOWEL + "wxY"


def _has_vowel(part: str) -> bool:
    return any(c in _VOWEL for c in part)


@lru_cache(100_000)
def stem(word: str) -> str:
    word = word.replace("’", "'").lstrip("'")
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _INVARIANT:
        return word
    word = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word.lower()
    # 1b
    if word.endswith(("eed", "eedly")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        suffix = next((s for s in ("ingly", "edly", "ing", "ed") if word.endswith(s)), "")
        if suffix and _has_vowel(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLE):
                word = word[:-1]
            elif _short_end(word) and r1 >= len(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    # 2
    for suffix, new in _STEP2:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + new
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple(_LI):
            word = word[:-2]
    # 3
    for suffix, new in _STEP3:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    # 4
    for suffix in _STEP4:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r2:
                word = word[: -len(suffix)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def tokens(text: str, stemmed: bool = True) -> Iterator[tuple[str, int]]:
    """(lexeme, position); stop words are left out but count as positions, and a hyphenated word comes before its parts."""
    at = 0
    for m in TOKEN.finditer(text):
        word = m[0].lower()
        for part in [word, *word.split("-")] if "-" in word else [word]:
            at += 1
            if part not in STOP:
                yield (stem(part) if stemmed else part), at


def position_vector(text: str | None, stemmed: bool = True) -> list[dict]:
    found: dict[str, list[int]] = {}
    for lexeme, at in tokens(text or "", stemmed):
        places = found.setdefault(lexeme, [])
        at = min(at, MOST_POSITION)
        if len(places) < MOST_POSITIONS and (not places or places[-1] != at):
            places.append(at)
    return [{"lexeme": k, "positions": v} for k, v in sorted(found.items())]


def query_lexemes(query: str, stemmed: bool = True) -> list[str]:
    """Distinct lexemes of a query; a row matches if it has all of them, and none is matched by no row."""
    return sorted({x for x, _ in tokens(query, stemmed)})


def rank(places: list[list[int]]) -> float:
    """Rank of a row by the positions of each query lexeme."""
    end = np.cumsum([len(x) for x in places]).reshape(-1, 1)
    return float(ranks(np.concatenate(places), end - [[len(x)] for x in places], end)[0])


VECTOR = "array<struct<lexeme: string, positions: array<int>>>"


def vectors_of(texts: pa.Array, stemmed: bool = True) -> pa.ListArray:
    """The position vector of each text."""
    lexemes, places, of_text, of_lexeme = [], [], [0], [0]
    for t in texts:
        for e in position_vector(t.as_py(), stemmed):
            lexemes.append(e["lexeme"])
            places += e["positions"]
            of_lexeme.append(len(places))
        of_text.append(len(lexemes))
    entries = pa.StructArray.from_arrays([pa.array(lexemes, pa.string()), pa.ListArray.from_arrays(pa.array(of_lexeme, pa.int32()), pa.array(places, pa.int32()))], ["lexeme", "positions"])
    return pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), entries)


def vector_column(text: Column, stemmed: bool = True) -> Column:
    @F.arrow_udf(VECTOR)
    def build(texts: pa.Array) -> pa.Array:
        return vectors_of(texts, stemmed)

    return build(text)


def shown(vector: Column) -> Column:
    """A position vector as text: each quoted lexeme with its places."""
    places = lambda e: F.array_join(F.transform(e["positions"], lambda p: p.cast("string")), ",")
    return F.array_join(F.transform(vector, lambda e: F.concat(F.lit("'"), e["lexeme"], F.lit("':"), places(e))), " ")


def rank_column(vector: Column, lexemes: list[str]) -> Column:
    """Rank of matching rows, null for the others. Rows that lack a lexeme never reach Python."""
    is_lexeme = lambda x: lambda e: e["lexeme"] == x
    has_all = F.lit(bool(lexemes))
    for x in lexemes:
        has_all = has_all & F.exists(vector, is_lexeme(x))

    wanted = F.array(*[F.filter(vector, is_lexeme(x))[0]["positions"] for x in lexemes]) if lexemes else F.lit(None).cast("array<array<int>>")
    return F.arrow_udf(ranks_of_places, "double")(F.when(has_all, wanted))


def best_first(rank: str = "rank", row_id: str = "id") -> list[Column]:
    """The order of rows by rank, equal ranks by id."""
    return [F.desc(F.round(rank, RANK_DIGITS)), F.asc(row_id)]


def exact_words(text: Column) -> Column:
    """Lower-cased words between characters that are neither letters nor digits."""
    return F.split(F.lower(text), "[^\\p{L}\\p{N}]+")


def exact_rank(words: Column, lexemes: list[str]) -> Column:
    """Native rank by exact words: the share of a text's words that a lexeme matches, null unless all lexemes occur.

    ``words`` should be a column of its own, so that texts are split once.
    """
    total = F.size(F.filter(words, lambda w: w.isin(*lexemes))) if lexemes else F.lit(0)
    has_all = F.lit(bool(lexemes))
    for x in lexemes:
        has_all = has_all & F.array_contains(words, x)
    return F.when(has_all, total / F.size(words))
