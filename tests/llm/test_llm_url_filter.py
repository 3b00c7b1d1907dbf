import math
import random

import pytest

from loci.llm import url_filter as u
from loci.llm.common import prepare


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def rule(host, path):
    best = None
    for says, text in u.RULES:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = (says, text)
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?q=1#f", "https://example.net/en", "https://example.net/en/", "ftp://badnet/", "http://net/",
    "http://x.net", "http://x.net?a://b/c", "http://m.example.com/de/1", "http://example.com/fr/1#a?b", "https://a.org/fr/", "https://org/fr/x\ny", "http://É.Net/é",
    "http://user@host.org/de/x.html?a=1&b=2", "a://b://c.net/", "http://x.com/" + "z" * 20_000,
]


@pytest.fixture(scope="module")
def pages(spark):
    prepare(spark)
    draw = random.Random(4)
    made = [f"http{draw.choice(['', 's'])}://{draw.choice(['a', 'blog', 'm'])}.x{draw.randrange(50)}.{draw.choice(['net', 'org', 'com'])}/{draw.choice(['en', 'fr', 'de'])}/{draw.randrange(999)}" for _ in range(400)]
    rows = [(i, x) for i, x in enumerate(URLS + made)] + [(None, URLS[4]), (4, URLS[4])]
    return spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS label", "'z' AS features")


def test_hosts_paths_and_rules(pages):
    by_id = dict(enumerate(URLS))
    got = u.judged(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        if r["page_id"] in by_id:
            host, path = parts(by_id[r["page_id"]])
            says, text = rule(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, text), by_id[r["page_id"]]
            assert r["verdict"] == says if says else r["verdict"] in ("allow", "block")
    assert sorted(map(str, got)) == sorted(map(str, u.judged(pages).collect()))


def test_trees_learn_the_rules(spark):
    prepare(spark)
    draw = random.Random(9)
    rows = [(i, f"http://{'a' * draw.randrange(3, 9)}.{s}/{'fr' if s == 'org' else 'en'}/{draw.randrange(9999)}") for i, s in enumerate(draw.choices(["net", "org"], k=600))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = u.judged(pages).where("rule IS NOT NULL").selectExpr("avg(CAST((p_block > 0.5) = (verdict = 'block') AS double)) AS right").first()
    assert got["right"] > 0.98


def test_entropy(spark):
    for text in ("", "a", "aab", "http://é.x/😀😀"):
        n = len(text)
        want = -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text)) if n else 0.0
        got = spark.createDataFrame([(text,)], "t string").select(u._entropy(u.F.col("t")).alias("e")).first()["e"]
        assert got == pytest.approx(want, abs=1e-9)


def test_one_kind_or_no_label(spark):
    prepare(spark)
    only = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in u.judged(only).collect()} == {1: "block", 2: "block"}
    assert {r["verdict"] for r in u.judged(only.where("page_id = 2")).collect()} == {"allow"}
    assert u.judged(only.limit(0)).count() == 0
