"""URL filters: rules first, and for urls that no rule fits, trust carried over the link graph of hosts.

Trust is a personalised PageRank from the hosts of allowed pages along links; distrust is the same from
the hosts of blocked pages against the links, since a host answers for what it links to. A host is blocked where its
distrust outweighs its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialise

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Steps go on until ranks, of a sum of 1, change by less than this in all over ROUND_CUT steps.
TOLERANCE = 1e-6
#: A host is blocked if its distrust is over RATIO times its trust, each a share of its kind's whole rank.
RATIO = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
#: Steps between two looks at the change.
ROUND_CUT = 3


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    name = verdict = F.lit(None).cast("string")
    for fit, (v, h, p) in zip(reversed(fits), reversed(ordered)):
        name, verdict = F.when(fit, F.lit(h + p)).otherwise(name), F.when(fit, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts. Links are counted by target within a partition first, so a host with most of the links is no hot key."""
    href = F.explode(F.regexp_extract_all("html", F.lit(HREF), 1))
    links = pages.select(F.col("host").alias("src"), href.alias("href")).filter(F.col("href").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    return links.select("src", host_of(full).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """kind, host, rank after ``rounds`` steps of personalised PageRank, or when ranks change by less than TOLERANCE.

    edges: kind, src, dst, n; seeds: kind, host, weight. Each kind is a graph of its own. Rank that a host without
    links would pass on is lost; once ranks have settled, scaling them to a sum of 1 is the same as handing it back to the seeds.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = materialise(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    seeds = materialise(seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("rank")))
    if rounds is None and is_empty(edges):
        rounds = 1
    rank = before = seeds
    i = 0
    while i != rounds:
        moved = edges.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = moved.unionByName(seeds.withColumn("rank", F.col("rank") * (1 - damping))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        i += 1
        rank = materialise(rank)  # the join of two written tables splits the links of a popular host
        if i % ROUND_CUT == 0 or i == rounds:
            if rounds is None:
                change = rank.unionByName(before.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("change"))
                if (change.agg(F.sum("change")).first()[0] or 0.0) < TOLERANCE:
                    break
                before = rank
    return rank


def judge_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, rounds: int | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust (of the host, as multiples of an even spread).

    Null urls and those without ``://`` have empty host and path, fit no rule and are allowed, as is any host that no seed
    reaches. Null html has no links. Rows that repeat an id are rows of their own, and their links count again; an empty
    table gives no rows.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = pages.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"))

    hosts = materialise(judged.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")))
    edges = materialise(host_edges(pages))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("weight")).unionByName(hosts.select(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("weight"))).filter("weight > 0")
    rank = propagate(both, seeds, rounds=rounds)
    rank = rank.join(F.broadcast(rank.groupBy("kind").agg(F.sum("rank").alias("all"))), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))
    count = F.lit(float(max(1, hosts.count())))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    score = rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    bad = F.col("distrust") > RATIO * F.col("trust") * (1 + TOLERANCE)
    score = score.select("host", bad.alias("bad"), *((F.round(k, 12) * count).alias(k) for k in ("trust", "distrust")))
    score = materialise(score)  # so that the partition of a host with most of the pages can be split
    out = judged.join(score, "host", "left").na.fill(0.0, ["trust", "distrust"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
