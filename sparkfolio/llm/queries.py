"""Queries of the operators, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_duplicates
from .language import identify_language
from .link_filter import judge_pages
from .mixing import mix
from .ogg import ogg_digests
from .quality import score_quality
from .ranked import rank_documents
from .repeats import remove_repeats
from .repetition import GRAM_LIMITS, LINE_LIMIT, judge_repetition
from .secrets import find_secrets
from .sentencepiece import encode_documents
from .simhash import simhash_groups
from .whitening import whiten


def _documents(operator: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _documents(find_secrets),
    "op2_exact_dedup": lambda spark, sf_dir: exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"),
    "op3_sentencepiece": _documents(encode_documents),
    "op4_url_filter": lambda spark, sf_dir: judge_pages(table(spark, sf_dir, "pages")),
    "op5_source_mix": lambda spark, sf_dir: mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken"),
    "op6_language_id": _documents(identify_language),
    "op7_quality_mil": lambda spark, sf_dir: score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_ogg_media": _documents(ogg_digests),
    "op9_repeat_removal": _documents(remove_repeats),
    "op10_simhash_groups": _documents(simhash_groups),
    "op11_ranked_search": lambda spark, sf_dir: rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_repetition_rules": _documents(judge_repetition),
    "op13_embedding_whitening": lambda spark, sf_dir: whiten(table(spark, sf_dir, "embeddings")),
}


def _gram_sql() -> str:
    """Runs of n words of each text as lists: whether they are found again, and the characters in those that repeat an earlier one."""
    parts = []
    for n in (*GRAM_LIMITS,):
        parts.append(f"""
        , g{n} AS (
            SELECT r, i, count(*) OVER (PARTITION BY r, gram) > 1 AS twice, row_number() OVER (PARTITION BY r, gram ORDER BY i) > 1 AS later
            FROM (SELECT r, unnest(range(1, greatest(len(words) - {n} + 2, 1))) AS i, words[i : i + {n - 1}] AS gram FROM t)
        ), c{n} AS (
            SELECT w.r, sum(CASE WHEN later THEN chars ELSE 0 END)::BIGINT AS dup_chars_{n}, count(*) FILTER (WHERE twice) AS n_twice_{n} FROM (
                SELECT word.r, chars, coalesce(bool_or(later) OVER run, false) AS later, coalesce(bool_or(twice) OVER run, false) AS twice
                FROM word LEFT JOIN g{n} g ON word.r = g.r AND word.i = g.i WINDOW run AS (PARTITION BY word.r ORDER BY word.i ROWS {n - 1} PRECEDING)
            ) w GROUP BY w.r
        )""")
    return "".join(parts)


_LIMITS = " OR ".join(f"100 * coalesce(dup_chars_{n}, 0) > {limit} * coalesce(word_chars, 0)" for n, limit in GRAM_LIMITS.items())

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op5_source_mix": r"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS h
            FROM documents
        ), per_source AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
            FROM sized GROUP BY source
        ), shared AS (  -- sources that stop at three times their size, by rounds
            SELECT 0 AS round, source, source_size, weight, false AS stops FROM per_source
            UNION ALL
            SELECT round + 1, source, source_size, weight,
                stops OR 3 * source_size * sum(CASE WHEN stops THEN 0 ELSE weight END) OVER ()
                    <= weight * (sum(source_size) OVER () - sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER ())
            FROM shared WHERE round < (SELECT count(*) FROM per_source)
        ), final AS (
            SELECT * FROM shared WHERE round = (SELECT count(*) FROM per_source)
        ), budget AS (
            SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE weight * (
                (sum(source_size) OVER () - sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
                / (sum(CASE WHEN stops THEN 0 ELSE weight END) OVER ())::DOUBLE) END AS target
            FROM final
        ), repeated AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM budget
        ), running AS (
            SELECT s.source, h, target - repeats * source_size AS want, sum(size) AS inside,
                sum(sum(size)) OVER (PARTITION BY s.source ORDER BY h) - sum(size) AS below
            FROM sized s JOIN repeated r ON s.source IS NOT DISTINCT FROM r.source WHERE size > 0
            GROUP BY s.source, h, target - repeats * source_size
        ), edge AS (
            SELECT source, max_by(CASE WHEN want - below >= below + inside - want THEN h + 1 ELSE h END, h) AS under
            FROM running WHERE below <= want GROUP BY source
        )
        SELECT doc_id, size, source_size, target, size * (repeats + CASE WHEN h < coalesce(under, 0) THEN 1 ELSE 0 END) AS taken
        FROM sized s JOIN repeated r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN edge e ON s.source IS NOT DISTINCT FROM e.source
    """,
    "op11_ranked_search": r"""
        WITH doc AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), item AS (
            SELECT row_number() OVER () AS b, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM benchmark
        ), total AS (
            SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc WHERE len(terms) > 0
        ), wanted AS (
            SELECT b, term, count(*) AS times FROM (SELECT b, unnest(terms) AS term FROM item) GROUP BY ALL
        ), posting AS (
            SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
        ), weight AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, total GROUP BY term, n_docs
        ), score AS (
            SELECT b, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms) * n_docs) // n_terms))))::BIGINT AS score
            FROM wanted JOIN weight USING (term) JOIN posting USING (term) JOIN doc USING (r), total GROUP BY b, r
        ), ranked AS (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
            FROM score JOIN doc USING (r) JOIN item USING (b) WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op12_repetition_rules": rf"""
        WITH t AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), word AS (
            SELECT r, unnest(range(1, len(words) + 1)) AS i, length(words[i]) AS chars FROM t
        ), line AS (
            SELECT r, count(*) - 1 AS again, (count(*) - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
            FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
        ), lines AS (
            SELECT r, sum(again)::BIGINT AS n_dup_lines, sum(chars)::BIGINT AS dup_line_chars FROM line GROUP BY r
        ), size AS (
            SELECT r, sum(chars)::BIGINT AS word_chars FROM word GROUP BY r
        ){_gram_sql()}, found AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_twice_8, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
                {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in GRAM_LIMITS)},
                len(words) < 20 OR 100 * coalesce(n_twice_8, 0) > 30 * len(words) AS base_failed,
                100 * coalesce(dup_line_chars, 0) > {LINE_LIMIT} * coalesce(word_chars, 0) OR {_LIMITS} AS over
            FROM t LEFT JOIN lines USING (r) LEFT JOIN size USING (r) {" ".join(f"LEFT JOIN c{n} USING (r)" for n in GRAM_LIMITS)}
        )
        SELECT * EXCLUDE (over), NOT base_failed AND NOT over AS kept FROM found
    """,
}
