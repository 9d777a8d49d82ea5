import pytest

from sparkfolio.llm import link_filter as L


def brute(links, seeds, rounds, damping=L.DAMPING):
    out = {}
    for a, _, n in links:
        out[a] = out.get(a, 0) + n
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    rank = dict(start)
    for _ in range(rounds):
        new = {h: (1 - damping) * r for h, r in start.items()}
        for a, b, n in links:
            if a in rank:
                new[b] = new.get(b, 0) + damping * rank[a] * n / out[a]
        rank = new
    return rank


def test_rank_is_that_of_plain_iteration(spark):
    links = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "c", 1), ("d", "a", 5), ("e", "f", 1)]
    seeds = {"a": 3, "e": 1}
    edges = spark.createDataFrame([("k", *x) for x in links], "kind string, src string, dst string, n long")
    got = {r["host"]: r["rank"] for r in L.propagate(edges, spark.createDataFrame([("k", h, w) for h, w in seeds.items()], "kind string, host string, weight long"), rounds=7).collect()}
    want = brute(links, seeds, 7)
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h]) for h in want)


def page(i, url, *links):
    return (i, url, "<p>" + "".join(f'<a class="x" href="{x}">y</a>' for x in links))


def test_distrust_goes_against_links_and_trust_along_them(spark):
    rows = [page(1, "http://bad.net/x"), page(2, "http://farm.test/", "http://bad.net/1", "http://bad.net/2"), page(3, "http://good.org/fr/", "https://Friend.test/a", "/own"), page(4, "http://friend.test/b"), page(5, "http://calm.test/")]
    rows += [page(10 + i, f"http://calm{i}.test/") for i in range(20)]
    out = {r["page_id"]: r for r in L.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i]["verdict"] for i in (1, 2, 3, 4, 5)] == ["block", "block", "allow", "allow", "allow"]
    assert out[1]["rule"] == "net/" and out[2]["rule"] is None
    assert out[2]["distrust"] > 0 and out[4]["trust"] > 0 and out[5]["trust"] == out[5]["distrust"] == 0


def test_rules_on_the_whole_table(spark, sf):
    from sparkfolio.llm.queries import QUERIES

    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op4_url_filter"](spark, sf).collect():
        rest = urls[r["page_id"]].split("://", 1)[1]
        host = rest
        for mark in "/?#":
            host = host.split(mark, 1)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        assert (r["host"], r["path"]) == (host, path)
        fits = [(h + p, v) for v, h, p in L.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits, key=lambda f: len(f[0]))
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def test_verdicts_do_not_depend_on_other_hosts(spark):
    rows = [page(i, f"http://bad{i}.net/") for i in range(6)]
    rows += [page(10, "http://farm.test/", "http://bad0.net/1"), page(11, "http://good.org/fr/", "http://friend.test/"), page(12, "http://friend.test/x")]
    rows += [page(20 + i, f"http://far{i}.test/", f"http://far{i + 1}.test/") for i in range(16)] + [page(36, "http://far16.test/", "http://bad1.net/")]
    idle = [page(100 + i, f"http://calm{i}.test/") for i in range(40)]
    verdicts = []
    for some in (rows, rows + idle):
        out = {r["page_id"]: r["verdict"] for r in L.judge_pages(spark.createDataFrame(some, "page_id long, url string, html string")).collect()}
        assert all(out.pop(r[0]) == "allow" for r in some if r[0] >= 100)
        verdicts.append(out)
    assert verdicts[0] == verdicts[1] == {r[0]: "allow" if r[0] in (11, 12) else "block" for r in rows}


def test_ranks_settle(spark):
    links = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "d", 1)]
    edges = spark.createDataFrame([("k", *x) for x in links], "kind string, src string, dst string, n long")
    got = {r["host"]: r["rank"] for r in L.propagate(edges, spark.createDataFrame([("k", "a", 1)], "kind string, host string, weight long")).collect()}
    want = brute(links, {"a": 1}, 300)
    assert sum(abs(got[h] - want[h]) for h in want) < 3 * L.TOLERANCE
