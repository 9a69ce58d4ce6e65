"""URL rules against a plain search over all rules."""

import random

from pyspark.sql import functions as F

from tellerflow.llm import queries, urlrules
from tellerflow.sources.tables import table

RULES = "host string, path string, action string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:stop], rest[stop:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def plain(url, rules):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), action, h + p) for h, p, action in rules
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = urlrules.judge(pages, spark.createDataFrame(rules, RULES)).collect()
    return {r.page_id: tuple(r.judged) for r in found}


def test_any_urls_and_rules(spark):
    rng = random.Random(3)
    labels, steps = ["a", "b", "org", "com", "", "x-1"], ["", "/", "/en", "/en/1", "/é", "//"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(steps) for _ in range(rng.randint(0, 3)))
    rules = sorted({(host(), path()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, a) for (h, p), a in rules]
    urls = [
        rng.choice(["http://", "HTTPS://", "://", "x"]) + rng.choice([host(), host().upper()]) + path() + rng.choice(["", "?q=/en", "#/en", "?#", "://a.org/"])
        for _ in range(600)
    ] + [None, "", "://", "http://", "http:///en/1", "a.org/en/1", "http://a.org:80/en", "http://u@a.org/", "http://É.ORG/en", "http://a\n.org/e\nn?x"]
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_short_prefixes_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "PREFIX_BYTES", 1)
    rules = [(f"h{i}.org", f"/{i}", "block" if i % 2 else "allow") for i in range(2000)]
    urls = [f"http://www.h{i}.org/{i + i % 3}x" for i in range(300)]
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_odd_rules_and_ties(spark):
    rules = [("a.org", "/", "block"), ("a.org", "/", "allow"), ("A.org", None, "allow"), (None, "/", "block"), ("", "/", "block"),
             ("b.org", "/", "ignore"), ("b.org", "/x", None), ("c.a.org", "", "block"), ("a.org", "/1", "allow")]
    got = judged(spark, ["http://a.org/", "http://a.org", "http://b.org/x", "http://c.a.org/1", "http://z/"], rules)
    assert [got[i][2:] for i in range(5)] == [("a.org/", "block"), ("a.org", "allow"), (None, "allow"), ("c.a.org", "block"), (None, "allow")]


def test_nulls_empty_tables_long_urls_and_clashing_names(spark):
    rules = spark.createDataFrame([("org", "/", "block")], RULES)
    long = "http://" + "a." * 200_000 + "org/" + "x/" * 200_000
    pages = spark.createDataFrame(
        [(1, long, "h"), (1, long, "h"), (None, None, None), (2, "http://b.org/?" + "q" * 300_000, "h")],
        "page_id long, url string, host string")
    for name in ("path", "rule", "verdict", "judged", "target_host", "prefix", "at"):
        pages = pages.withColumn(name, F.lit("mine"))
    out = urlrules.judge(pages, rules)
    assert out.columns == [*pages.columns, "_judged"] and out.count() == 4
    assert sorted((r.page_id or 0, r._judged.verdict, r.judged) for r in out.collect()) == [
        (0, "allow", "mine"), (1, "block", "mine"), (1, "block", "mine"), (2, "block", "mine")]
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r._judged.verdict for r in urlrules.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_registered_query(spark, sf_dir):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    found = queries.QUERIES["op11_url_rules"](spark, sf_dir).collect()
    want = sorted((r.page_id, *plain(r.url, rules)) for r in table(spark, sf_dir, "pages").collect())
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found) == want
    assert {v for *_, v in want} == {"allow", "block"} and len({r for *_, r, _ in want}) == 6


def test_rules_meet_urls_by_their_prefix(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    host, path = urlrules.host_and_path(F.col("url"))
    plan = urlrules.verdicts(pages.select(host.alias("host"), path.alias("path")), spark.createDataFrame([("org", "/", "block")], RULES))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in text.splitlines() if "Join Inner" in line)
    assert "prefix" in join and "sha2" not in join
