from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from cohortflow.llm import url_rules as U
from cohortflow.llm.queries import QUERIES
from tests.llm.helpers import SF


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]


def listed(host, path):
    fits = [r for r in U.LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)).text if fits else None


ODD = [None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "http://a.net?x/", "http://Xnet/", "https://www.Example.net/en/1", "https://example.net/en", "ftp://a.b.org/fr/x#y",
       "http://org/fr/", "http://forg/fr/", "a://b://c/d", "http://example.com/de/#", "http://É.ÀB.net/", "x://h\n.net/p\nq", "http://ex.com/" + "a/" * 3000, "http://h?" + "k=v&" * 2000, "http://[::1]:80/en/"]


def test_hosts_paths_and_listed_rules(spark):
    urls = ODD + [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    out = {r["page_id"]: r for r in U.judge(frame(spark, urls)).collect()}
    assert len(out) == len(urls)
    for i, url in enumerate(urls):
        assert (out[i]["host"], out[i]["path"]) == split(url), url
        assert out[i]["rule"] == listed(*split(url)), url
        if out[i]["rule"]:
            assert out[i]["verdict"] == next(r.verdict for r in U.LISTED if r.text == out[i]["rule"])
        assert out[i]["verdict"] in ("allow", "block")


def brute_rules(baskets, min_support, min_confidence):
    """All rules tokens -> verdict by counting, without those that fewer tokens give as surely."""
    n, seen, label = len(baskets), Counter(), Counter()
    for tokens, verdict in baskets:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                seen[c] += 1
                if verdict:
                    label[(c, verdict)] += 1
    rules = {(c, v): m / seen[c] for (c, v), m in label.items() if m >= min_support * n and m / seen[c] >= min_confidence}
    return {(c, v): s for (c, v), s in rules.items() if not any((d, v) in rules and rules[(d, v)] >= s for k in range(1, len(c)) for d in combinations(c, k))}


def test_mined_rules_and_matches_equal_counting(spark):
    urls = [f"http://s{i % 3}.example.{('net', 'com', 'org')[i % 3]}/{('en', 'de', 'fr')[i // 3 % 3]}/{i}" for i in range(90)] + ["http://s1.example.com/de", "http://s9.example.com/xx/de/"]
    judged = U.listed_verdict(U.parse(frame(spark, urls))).withColumn("tokens", U.tokens())
    rows = judged.collect()
    want = brute_rules([(r["tokens"], r["listed"]) for r in rows], 0.05, 0.8)
    mined = U.mine(spark, judged, 0.05, 0.8)
    got = {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in mined.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    best = {tuple(r["tokens"]): r["mined"] for r in U.match(judged.select("tokens").distinct(), mined).collect()}
    for r in rows:
        fits = [s for (c, _), s in want.items() if set(c) <= set(r["tokens"])]
        assert (tuple(r["tokens"]) in best) == bool(fits)
        if fits:
            assert abs(best[tuple(r["tokens"])]["confidence"] - max(fits)) < 1e-9


def test_query_covers_every_page(spark):
    out = QUERIES["op6_url_rules"](spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_repeats_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://b.com/x"), (2, None)], "page_id bigint, url string")
    for c in ("host", "path", "rule", "listed", "tokens", "verdict", "confidence", "token"):
        df = df.withColumn(c, F.lit("clash"))
    out = U.judge(df).collect()
    assert len(out) == 4 and [r["verdict"] for r in out if r["page_id"] == 1] == ["block", "block"]
    assert U.judge(frame(spark, []).select("page_id", "url")).count() == 0
    assert {r["verdict"] for r in U.judge(frame(spark, ["http://x.de/", None])).collect()} == {"allow"}


def test_mining_sees_every_token_of_a_long_url(spark):
    rows = [([f"query=k{i}x{j}" for j in range(45)] + ["site=bad.example"], "block") for i in range(30)] + [(["site=good.example"], None)] * 30
    rules = U.mine(spark, spark.createDataFrame(rows, "tokens array<string>, listed string"), min_support=0.4)
    assert [(r["tokens"], r["verdict"], r["support"]) for r in rules.collect()] == [(["site=bad.example"], "block", 0.5)]
