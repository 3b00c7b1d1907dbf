import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loci.llm import site_quality as sq
from loci.llm.common import prepare


@pytest.fixture(scope="module")
def tables(spark):
    prepare(spark)
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        host = f"h{i % 7}"
        bad = draw.random() < (0.8 if host == "h1" else 0.1)
        words = ["BUY!!", "$$$win", "###", "CLICK&&&"] if bad else ["the", "house", "was", "old", "and", "green."]
        rows.append((i, " ".join(draw.choice(words) for _ in range(draw.randrange(20, 90))), host, f"{host}/{i % 3}"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows += [(800, None, "h1", None), (801, "", None, None), (None, "the house", "lonely", "lonely/x"), (1, rows[1][1], "h1", "h1/1"), (802, "old " * 50_000, "h2", "h2/0")]
    labels += [(1, 1, 0), (None, 1, 0), (9, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string").selectExpr("*", "1 AS host", "2 AS p", "3 AS y", "4 AS n")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def judged(docs, labels):
    return sq.judged(docs, labels, F.col("source"), F.col("part"))


def test_levels_match_brute_force(tables):
    docs, labels = tables
    got = judged(docs, labels).collect()
    assert len(got) == docs.count()
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r["host"]].append(r["p_doc"])
        paths[r["host"], r["path"]].append(r["p_doc"])
    everything = [p for v in hosts.values() for p in v]
    mean = np.mean(everything)

    def strength(groups):
        between = sum(len(v) * (np.mean(v) - mean) ** 2 for v in groups.values()) / len(everything)
        chance = sum(np.var(v) for v in groups.values()) / len(everything)
        return np.clip(mean * (1 - mean) / max(between - chance, 1e-6) - 1, 1, 1e5)

    k_host, k_path = strength(hosts), strength(paths)
    for r in got:
        p_host = (k_host * mean + sum(hosts[r["host"]])) / (k_host + len(hosts[r["host"]]))
        own = paths[r["host"], r["path"]]
        p_path = (k_path * p_host + sum(own) - r["p_doc"]) / (k_path + len(own) - 1)
        odds = r["p_doc"] / (1 - r["p_doc"]) * p_path / (1 - p_path) * (1 - mean) / mean
        assert r["p_host"] == pytest.approx(p_host) and r["p_path"] == pytest.approx(p_path)
        assert r["p_good"] == pytest.approx(odds / (1 + odds)) and r["kept"] == (r["p_good"] >= 0.5)


def test_held_out_labels(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in judged(docs, labels).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    right = [got[i]["kept"] == ("house" in text[i] or "old" in text[i]) for i in range(0, 300, 2)]
    assert np.mean(right) > 0.95


def test_no_labels_and_empty(tables):
    docs, labels = tables
    assert {r["p_doc"] for r in judged(docs, labels.limit(0)).collect()} == {0.5}
    assert judged(docs.limit(0), labels).count() == 0
