import math

import pytest
from pyspark.sql import functions as F

from freightlens.llm import urls
from freightlens.llm.queries import RULES

URLS = [
    None, "", "no scheme", "http://Example.COM/en/x?q=1#f", "https://www.example.com/en/", "https://a.www.example.com/en/1", "http://com", "http://com/",
    "http://notexample.com/en/", "http://net/es/", "http://x.net/fr/2?p", "http://x.net/en/", "x://a.net?/es/", "http://ÉA.org/é", "a://b://c/d", "http://q.org/" + "9" * 5000,
]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def rule(host, path):
    hits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(hits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumns({"host": F.lit(1), "_url": F.lit(2)})
    rows = urls.filtered(pages, RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = host_path(URLS[r["page_id"]])
        text, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, text)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_trees_learn_what_rules_say(spark):
    """Long numeric paths on .net are blocked by rule; the same shape elsewhere without a rule follows."""
    rows = [(i, f"http://h{i % 9}.net/es/{i}{'7' * 30}?a=1&b=2") for i in range(300)] + [(1000 + i, f"https://h{i % 9}.com/about-us") for i in range(300)]
    rows += [(2000, f"http://h1.org/es/{'7' * 33}?a=1&b=2"), (2001, "https://h2.org/about-us")]
    got = {r["page_id"]: r["verdict"] for r in urls.filtered(spark.createDataFrame(rows, "page_id long, url string"), RULES).where("page_id >= 2000").collect()}
    assert got == {2000: "block", 2001: "allow"}


@pytest.mark.parametrize(("rules", "want"), [([], "allow"), ([urls.Rule("block", "com", "/")], "block"), ([urls.Rule("allow", "com", "/")], "allow")])
def test_one_verdict_or_none(spark, rules, want):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.org/x"), (2, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.filtered(pages, rules).where("rule IS NULL").collect()} == {want}
    assert urls.filtered(pages.limit(0), rules).count() == 0


def test_suffix_statistics_count_all_labelled_urls(spark, monkeypatch):
    """A sample of a few URLs changes neither the shares nor the counts that the trees see."""
    rows = [(i, f"http://h.d{i % 40}.net/{'es' if i % 3 else 'fr'}/{i}") for i in range(400)] + [(1000 + i, f"http://d{i % 40}.com/{i}") for i in range(400)]
    rows += [(2000 + i, f"http://d{i}.net/en/") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    seen = {}
    inner = urls._judged

    def judged(frame, score, plan, kept):
        seen["rows"] = frame.where("_row.page_id >= 2000").select("host", "_domain_share", "_domain_seen", "_top_share", "_top_seen").collect()
        return inner(frame, score, plan, kept)

    monkeypatch.setattr(urls, "_judged", judged)
    for sample in (60, 9_000):
        assert urls.filtered(pages, RULES, urls.Trees(sample=sample)).count() == len(rows)
        assert len({r["host"] for r in seen["rows"]}) == 40
        for r in seen["rows"]:
            assert abs(r["_domain_seen"] - math.log1p(10)) < 1e-9 and abs(r["_domain_share"] - (10 + 20 * 0.5) / 30) < 1e-9
            assert abs(r["_top_seen"] - math.log1p(400)) < 1e-9 and abs(r["_top_share"] - (400 + 20 * 0.5) / 420) < 1e-9


def test_copies_of_a_url_are_thinned_evenly(spark, monkeypatch):
    rows = [(i, "http://a.net/es/1") for i in range(3000)] + [(5000 + i, f"http://a.com/{i}") for i in range(1000)]
    drawn = {}
    inner = urls.stage

    def staged(frame, name):
        out = inner(frame, name)
        if "_label" in out.columns and "host" in out.columns:
            drawn["n"] = out.where("_label = 1").count()
        return out

    monkeypatch.setattr(urls, "stage", staged)
    urls.filtered(spark.createDataFrame(rows, "page_id long, url string"), RULES, urls.Trees(sample=400, rounds=1))
    assert 200 < drawn["n"] < 400


def test_entropy(spark):
    texts = ["", "a", "ab", "aabb", "abcd", "ééa"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", urls.entropy(F.col("t")).alias("e")).collect():
        t = r["t"]
        assert abs(r["e"] + sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))) < 1e-9


def test_columns_with_the_names_of_helpers_stay(spark):
    rows = [(i, f"http://a{i % 5}.{'net/es' if i % 2 else 'com'}/{i}", i) for i in range(60)] + [(100, "http://x.org/", 7), (101, None, 8)]
    names = ["_rule", "_domain", "_top", "_features", "_raw", "_row", "_url", "_label", "_draw", "none", "a.b"]
    pages = spark.createDataFrame(rows, "page_id long, url string, n int").withColumns({c: F.col("n") for c in names})
    out = urls.filtered(pages, RULES, urls.Trees(rounds=1))
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict", "score"]
    assert all(r[c] == r["n"] for r in out.collect() for c in names) and out.count() == len(rows)
