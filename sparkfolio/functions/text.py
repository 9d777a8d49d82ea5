"""Text functions as native column expressions; they stay inside the JVM.

White space is Python's, which is wider than Spark's ``trim`` and Java's ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's str.strip and split treat as white space.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Words that carry no topic in a query.
STOPWORDS = """
    what which who whom where when why how
    to of in for on with at by from as into about a an the
    and or but if then
    this that these those i you he she it we they my your his her its our their
    is are was were be been being have has had do does did can could would should may might must
    some any all both each every other another such only own same so than too very just also
    include includes including contain contains show shows find search look looking tell explain describe
    give get know somehow something anything everything please help need want
""".split()


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def _each_line(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), change), "\n")


def clean_text(text: Column) -> Column:
    """Text ready to be chunked: one line end, single blanks, at most one empty line in a row, stripped lines.

    Lines of blanks are emptied after runs of line ends were shortened, so three line ends can remain.
    Null becomes the empty text.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(_each_line(text, strip))


def normalize_whitespace(text: Column) -> Column:
    """The milder cleaning: runs of spaces and of line ends, stripped lines. Null stays null."""
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(_each_line(text, strip))


def strip_line_numbers(text: Column) -> Column:
    """Without three-digit numbers at the start of lines, if over 10 of the first 20 lines have one."""
    number = rf"\A[{SPACE}]*\d{{3}}[{SPACE}]+"
    lines = F.split(text, "\n", -1)
    numbered = F.size(F.filter(F.slice(lines, 1, 20), lambda x: x.rlike(number)))
    return F.when(numbered > 10, _each_line(text, lambda x: F.regexp_replace(x, number, ""))).otherwise(text)


def truncate(text: Column, most: int = 500, suffix: str = "...") -> Column:
    """At most ``most`` characters, cut at the last space if that is in the second half."""
    head = F.substring(text, 1, most - len(suffix))
    space = F.length(head) - F.locate(" ", F.reverse(head))  # place of the last space, from 0
    head = F.when((F.locate(" ", head) > 0) & (space > most // 2), F.left(head, space)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit(suffix)))


def _matched(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def latex_of_description(text: Column) -> Column:
    """What follows ``LaTeX:`` in any case, up to the first sentence end."""
    found = strip(_matched(text, rf"(?is)LaTeX:[{SPACE}]*(.+)"))
    return F.split(found, rf"\.[{SPACE}]+[A-Z]", 2)[0]


def parsed_latex(text: Column) -> Column:
    """What follows ``LaTeX:``, without enclosing parentheses or dollar signs."""
    found = strip(_matched(text, rf"(?s)LaTeX:[{SPACE}]*(.+)"))
    found = F.regexp_replace(found, r"(?s)\A\\?\((.+)\\?\)\z", "$1")
    return strip(F.regexp_replace(found, r"(?s)\A\$(.+)\$\z", "$1"))


def strip_think_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?s)<think>.*?</think>[{SPACE}]*", ""))


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first letter; unlike ``initcap``, also after digits and marks."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def title_of_slug(slug: Column) -> Column:
    """A title from a slug: without version suffix, marks as spaces, in title case."""
    return title_case(F.translate(F.regexp_replace(slug, r"[-_]?(v\d+|\d{4}v\d+)\z", ""), "_-", "  "))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def keywords_of_query(query: Column) -> Column:
    """The query's words without stop words; marks stay attached to words, so ``how?`` is not a stop word."""
    words = F.filter(F.split(strip(query), rf"[{SPACE}]+"), lambda w: (w != "") & ~F.lower(w).isin(*STOPWORDS))
    return F.array_join(words, " ")


#: Marks of a question about figures, tables and the like.
ELEMENT_PATTERNS = (
    r"\b(formula|formulas|equation|equations)\b",
    r"\b(figure|figures|diagram|diagrams|chart|charts)\b",
    r"\b(table|tables)\b",
    r"\b(image|images|picture|pictures|visual|visuals)\b",
    r"\b(show|display|see|view)\b.*\b(image|figure|diagram|chart|table|equation|picture|visual|formula)",
    r"\b(image|figure|diagram|chart|table|equation|picture|visual|formula)s?\b.*\b(of|about|related|for)\b",
    r"\bare there\b.*\b(image|figure|diagram|chart|picture|visual|formula|equation)s?\b",
    r"\bwhat\b.*\b(figure|diagram|chart|table|formula|equation)s?\b",
)
#: How a follow-up question starts, and how one refers back.
FOLLOWUP_STARTS = (r"i mean[t]?\b", r"actually\b", r"no[,.]?\s", r"not that[,.]?\s", r"what about\b", r"how about\b", r"and\b", r"or\b", r"but\b")
FOLLOWUP_PREFIX = r"\A(i mean[t]?|actually|no[,.]?|not that[,.]?|what about|how about|and|or|but)\s*"
REFERENCE = r"\b(related to|about|for|of|on)\s+(this|that|it|these|those)\b"
REFERENCES = (
    REFERENCE,
    r"\b(this|that)\s+(topic|subject|projection|method)\b",
    r"\bany\b.*\b(related|about|for)\b.*\b(this|that|it)\b",
    r"\A(any|are there|show me|what)\b.*\b(this|that|it)\s*\??\z",
)


def _any_of(text: Column, patterns, start: str = "") -> Column:
    return text.rlike("(?U)" + start + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def asks_for_elements(question: Column) -> Column:
    return _any_of(F.lower(question), ELEMENT_PATTERNS)


def expand_followup(question: Column, last: Column) -> Column:
    """The question with the previous query behind it if it follows up on that, lower-cased then, else as it is."""
    q = strip(F.lower(question))
    short = strip(F.regexp_replace(q, "(?U)" + FOLLOWUP_PREFIX, ""))
    plain = strip(F.regexp_replace(q, "(?U)" + REFERENCE, ""))
    plain = strip(F.regexp_replace(plain, rf"[?{SPACE}]+", " "))
    starts = _any_of(q, FOLLOWUP_STARTS, r"\A")
    return (
        F.when(F.coalesce(last, F.lit("")) == "", question)
        .when(starts & (short != ""), F.concat_ws(" ", short, last))
        .when(starts, question)
        .when(_any_of(q, REFERENCES), F.concat_ws(" ", plain, last))
        .otherwise(question)
    )


def search_terms(answer: Column, question: Column) -> Column:
    """Search terms a model proposed, or the question where it proposed none."""
    terms = strip(F.regexp_replace(strip(answer), "[\"'\\n]", F.lit("")))
    return F.when((terms == "") | terms.startswith("Error") | terms.isNull(), question).otherwise(terms)


def summary_of(response: Column) -> Column:
    return strip(_matched(response, rf"(?is)SUMMARY:[{SPACE}]*(.+?)(?=KEYWORDS:|\z)"))


def keywords_of(response: Column, most: int = 10) -> Column:
    listed = strip(F.regexp_extract(response, rf"(?is)KEYWORDS:[{SPACE}]*(.+)", 1))
    words = F.transform(F.split(listed, ",", -1), lambda w: F.lower(strip(w)))
    return F.slice(F.filter(words, lambda w: w != ""), 1, most)


def license_of(response: Column) -> Column:
    text = strip_think_tags(response)
    return F.when((text != "") & (F.upper(text) != "NONE"), text)


def license_input(first: Column, last: Column) -> Column:
    """Both ends of a document as the model is shown them; a page without text counts as empty."""
    first, last = (F.substring(F.coalesce(c, F.lit("")), 1, 2000) for c in (first, last))
    return F.concat(F.lit("FIRST PAGE:\n"), first, F.lit("\n\nLAST PAGE:\n"), last)


def preview(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(suffix))).otherwise(text)


def mime_of(path: Column) -> Column:
    """MIME type by suffix, null for a suffix that is not served or a path that leaves its folder."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    mime = F.when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix.isin("png", "gif", "webp"), F.concat(F.lit("image/"), suffix))
    return F.when(path.startswith("/") | F.array_contains(F.split(path, "/"), ".."), None).otherwise(mime)


def element_file_name(page: Column, kind: Column, index: Column, label: Column) -> Column:
    label = F.regexp_replace(label, r"(?U)[^\w\s-]", "")
    label = F.left(F.regexp_replace(label, rf"[{SPACE}]+", "_"), F.lit(30))
    return F.concat(F.lit("p"), F.when(page < 10, F.concat(F.lit("0"), page.cast("string"))).otherwise(page.cast("string")), F.lit("_"), kind, F.lit("_"), index.cast("string"), F.lit("_"), label, F.lit(".png"))


def cache_label(label: Column) -> Column:
    return F.regexp_replace(label, r"(?U)[^\w\-]", "_")


def rgb_of_hex(color: Column) -> Column:
    part = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("int")
    return F.array(part(2), part(4), part(6))


#: Colours of element kinds.
COLORS = {"figure": "#FF6B6B", "table": "#4ECDC4", "equation": "#45B7D1", "chart": "#96CEB4", "diagram": "#FFEAA7"}
OTHER_COLOR = "#DDA0DD"


def color_of(kind: Column) -> Column:
    out = F.lit(OTHER_COLOR)
    for k, v in COLORS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out
