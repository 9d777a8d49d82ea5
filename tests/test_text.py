import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.functions import lexical, parse, text


def one(spark, make, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize("given_text", ["  a ", " x\x1c", "", "a b", "\n\na\n"])
def test_strip_is_pythons(spark, given_text):
    assert one(spark, text.strip, given_text) == given_text.strip()


@pytest.mark.parametrize("dirty, clean", [("a\r\nb\rc", "a\nb\nc"), ("a \t b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("a\n \n \nb", "a\n\n\nb"), (" x \n y ", "x\ny"), (None, "")])
def test_clean_text(spark, dirty, clean):
    assert one(spark, text.clean_text, dirty) == clean


def test_line_numbers_go_only_where_most_lines_have_one(spark):
    numbered = "\n".join(f"{i:03d}  line {i}" for i in range(15))
    assert one(spark, text.strip_line_numbers, numbered) == "\n".join(f"line {i}" for i in range(15))
    few = "001 a\n002 b\nc"
    assert one(spark, text.strip_line_numbers, few) == few


@pytest.mark.parametrize("most", [20, 30, 50])
def test_truncate_keeps_to_its_length_and_ends_at_a_word(spark, most):
    long = "several words that go on for quite some time and more"
    cut = one(spark, lambda c: text.truncate(c, most), long)
    assert len(cut) <= most and cut.endswith("...")
    assert long.startswith(cut[:-3])
    assert one(spark, lambda c: text.truncate(c, most), "short") == "short"


@pytest.mark.parametrize("given_text, latex", [("LaTeX: x^2", "x^2"), ("A latex:  y. The end", "y"), ("none", None), ("", None), (None, None)])
def test_latex_of_description(spark, given_text, latex):
    assert one(spark, text.latex_of_description, given_text) == latex


@pytest.mark.parametrize("given_text, latex", [("LaTeX: $a+b$", "a+b"), (r"LaTeX: \(x\)", "x\\"), ("latex: x", None)])
def test_parsed_latex(spark, given_text, latex):
    assert one(spark, text.parsed_latex, given_text) == latex


def test_think_tags_go(spark):
    assert one(spark, text.strip_think_tags, "<think>a\nb</think>\n yes <think>c</think>") == "yes"


@pytest.mark.parametrize("slug", ["a_b-c_v2", "2511.00073v1", "the_4th-map", "plain"])
def test_title_of_slug_is_pythons_title(spark, slug):
    plain = re.sub(r"[-_]?(v\d+|\d{4}v\d+)$", "", slug)
    assert one(spark, text.title_of_slug, slug) == plain.translate(str.maketrans("_-", "  ")).title()


@pytest.mark.parametrize("answer, summary, words", [("SUMMARY: s\nKEYWORDS: A, b ,, c", "s", ["a", "b", "c"]), ("keywords: x", None, ["x"]), ("Summary: only", "only", []), ("SUMMARY: KEYWORDS: a", "KEYWORDS: a", ["a"])])
def test_summary_and_keywords(spark, answer, summary, words):
    assert one(spark, text.summary_of, answer) == summary
    assert one(spark, lambda c: text.keywords_of(c, 8), answer) == words


def test_keywords_keep_attached_marks_and_case(spark):
    assert one(spark, text.keywords_of_query, "what papers include Ann Lee somehow?") == "papers Ann Lee somehow?"
    assert one(spark, text.keywords_of_query, "what is the") == ""


@pytest.mark.parametrize("answer, out", [("none", None), ("<think>x</think>NONE", None), ("", None), (" CC BY ", "CC BY")])
def test_license(spark, answer, out):
    assert one(spark, text.license_of, answer) == out


@pytest.mark.parametrize(
    "question, last, out",
    [("What about maps?", "old", "maps? old"), ("and", "old", "and"), ("Any work related to this?", "old", "any work old"), ("Who wrote it", "old", "Who wrote it"), ("and maps", "", "and maps"), ("and maps", None, "and maps")],
)
def test_followups(spark, question, last, out):
    assert one(spark, text.expand_followup, question, last) == out


@pytest.mark.parametrize("question, yes", [("Show the FIGURE", True), ("tables?", True), ("comfortable chairs", False), ("who is it", False)])
def test_questions_for_elements(spark, question, yes):
    assert one(spark, text.asks_for_elements, question) is yes


@pytest.mark.parametrize("path, mime", [("a.JPG", "image/jpeg"), ("a/b.webp", "image/webp"), ("../a.png", None), ("/a.png", None), ("a.txt", None)])
def test_mime(spark, path, mime):
    assert one(spark, text.mime_of, path) == mime


@pytest.mark.parametrize(
    "answer, rows",
    [
        ('{"figures": [{"bbox": [0, 0, 500, 1000], "label": "F"}]}', [("figure", [0, 10, 500, 1010], "F", "")]),
        ('x ```json\n{"table": [{"bbox_2d": [1, 2, 3, 4]}]}\n``` y', [("table", [1, 12, 3, 14], "table", "")]),
        ('```\n{"chart": []}\n```', []),
        ('{"chart": "none", "diagram": [{"bbox": [1, 2, 3]}]}', []),
        ('{"equation": [{"bbox": [1,1,2,2], "description": "LaTeX: \\alpha"}]}', [("equation", [1, 11, 2, 12], "equation", "LaTeX: \\alpha")]),
        ('{"figure": [{"bbox": [1,', []),
        ("no json", []),
        (None, []),
    ],
)
def test_elements_of_answers(spark, answer, rows):
    pages = spark.createDataFrame([(answer, 1000, 1000)], "answer string, width int, height int")
    found = parse.elements_of_answers(pages).orderBy("element_index").collect()
    assert [(r["type"], r["bbox_pixels"], r["label"], r["description"]) for r in found] == rows


#: Words with their stems, from the published description of the English stemmer.
STEMS = "consign consign,consigned consign,consistency consist,knightly knight,generously generous,national nation,relational relat,hopping hop,hoping hope,flies fli,cried cri,ties tie,gas gas,kiwis kiwi,happy happi,cry cri,by by,say say,skies sky,dying die,agreed agre,feed feed,luxuriated luxuri,triplicate triplic,probate probat,rate rate,controlling control,proceed proceed,news news"


@pytest.mark.parametrize("word, root", [x.split() for x in STEMS.split(",")])
def test_stems(word, root):
    assert lexical.stem(word) == root


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeginsty'", max_size=12))
def test_stemming_never_fails_and_never_grows_much(word):
    assert len(lexical.stem(word)) <= len(word) + 1


def test_position_vector_counts_stop_words():
    found = {e["lexeme"]: e["positions"] for e in lexical.position_vector("The maps of the map-maker")}
    assert found == {"map": [2, 6], "map-mak": [5], "maker": [7]}


def test_rank():
    assert lexical.rank([[3]]) == pytest.approx(0.060793, abs=1e-6)
    assert lexical.rank([[1], [2]]) == pytest.approx(0.099103, abs=1e-6)
    near, far = lexical.rank([[1], [11]]), lexical.rank([[1], [12]])
    assert 1 - 2 * near <= 0.94 < 1 - 2 * far
