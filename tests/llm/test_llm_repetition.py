import re

import numpy as np
import oracle
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import queries, repetition
from sparkfolio.llm.common import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words, chars = WORD.findall(text), 0
    lines, seen, again = text.split("\n"), set(), []
    for line in lines:
        if WORD.search(line):
            if line in seen:
                again.append(line)
            seen.add(line)
    chars = [len(w) for w in words]
    out = {"n_words": len(words), "word_chars": sum(chars), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(again), "dup_line_chars": sum(len(w) for x in again for w in WORD.findall(x))}
    for n in repetition.GRAM_LIMITS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        later = {j for i, g in enumerate(grams) if g in grams[:i] for j in range(i, i + n)}
        out[f"dup_chars_{n}"] = sum(chars[j] for j in later)
        if n == 8:
            out["n_repeat_words"] = len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)})
    return out


def fast(texts):
    found = repetition.coverage(*utf8(pa.array(texts, pa.string())))
    return [{c: int(found[c][i]) for c in repetition.COLUMNS} for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ä#", "\n", "\n", " ", "\r", "\t", "x"]), max_size=60).map(" ".join), min_size=1, max_size=5))
def test_measures_equal_brute_force(texts):
    assert fast(texts) == [slow(t) for t in texts]


def test_measures_across_text_bounds_and_long_texts():
    line = "one two three four five six seven eight nine ten"
    texts = [line, line, "", line + "\n" + line, (line + "\n") * 500, None]
    assert fast(texts) == [slow(t or "") for t in texts]


def test_equals_its_sql(spark, sf):
    oracle.same(queries.QUERIES["op12_repetition_rules"](spark, sf), oracle.connect(sf), queries.ORACLE_SQL["op12_repetition_rules"])


def test_verdicts(make):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    line = prose(9)
    rows = [(1, None), (2, ""), (3, prose(19)), (4, prose(20)), (5, line + "\n" + prose(60) + "\n" + line), (6, "\n".join([line] * 8)), (7, (prose(6) + " ") * 3 + " ".join(f"{w} " * 7 for w in prose(10).split()))]
    rows += [(8, prose(400)), (8, prose(400)), (None, prose(50))]
    out = {r["doc_id"]: r for r in repetition.judge_repetition(make(rows)).collect()}
    assert [out[i]["base_failed"] for i in (1, 2, 3, 4, 5, 6, 7)] == [True, True, True, False, False, True, False]
    assert [out[i]["kept"] for i in (1, 3, 4, 5, 6, 7, 8, None)] == [False, False, True, True, False, False, True, True]
    strict = {r["doc_id"]: r["kept"] for r in repetition.judge_repetition(make(rows), line_limit=5).collect()}
    assert strict[5] is False and strict[4] is True
