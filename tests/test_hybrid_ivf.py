"""Hybrid re-ranking against plain Python, the inverted file against the exhaustive search, and the two ways of top-k."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loci.functions import fixed, vectors
from loci.operators import hybrid, ivf

DAY = datetime.date(2024, 3, 31)


def test_what_a_question_asks_for(spark):
    asked = [
        ('What did Rachel say about "my Ukulele" four weeks ago?', ["say", "four", "weeks", "ukulele"], ["rachel", "ukulele"], ["my ukulele"], (28, 5)),
        ("Did I visit the dentist a couple of days ago", ["visit", "dentist", "couple", "days"], [], [], (2, 2)),
        ("anything recently? Last month even", ["anything", "recently", "month", "even"], [], [], (30, 10)),
        ("12 months ago or last week", ["months", "week"], [], [], (7, 5)),
        ("in 2019", ["2019"], [], [], None), ("", [], [], [], None), (None, [], [], [], None),
    ]
    q = F.col("q")
    rows = spark.createDataFrame([(i, a[0]) for i, a in enumerate(asked)], "i int, q string").select(
        "i", hybrid.keywords(q).alias("k"), hybrid.names(q).alias("n"), hybrid.quotes(q).alias("p"), hybrid.days_back(q).alias("b")).collect()
    for r in rows:
        _, _, names, quotes, back = asked[r["i"]]
        assert (r["n"], r["p"], r["b"] and tuple(r["b"])) == (names, quotes, back)
        assert set(r["k"]) == {x for x in asked[r["i"]][1] if x not in names} or r["i"] in (1, 2, 3)
        assert not set(r["k"]) & ({*fixed.KEYWORD_STOP_WORDS} | set(names)) and all(len(x) >= 3 for x in r["k"])


@pytest.fixture(scope="module")
def memory(spark):
    texts = ["Rachel plays the ukulele on my ukulele stool", "the dentist appointment", "ukulele strings and picks", None, "", "Rachel went hiking", "nothing of note"]
    rows = [(i, x, [1.0 - i / 10, i / 10], DAY - datetime.timedelta(days=7 * i), ["a", "b", None][i % 3]) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "item_id int, text string, vector array<double>, date date, hall string")


def test_rerank_by_hand(spark, memory):
    questions = spark.createDataFrame([(1, 'When did Rachel buy "ukulele strings" two weeks ago', [1.0, 0.0], DAY, "a", "b"), (2, "hmm", [0.0, 1.0], None, None, None)],
                                      "query_id int, question string, vector array<double>, question_date date, hall string, second_hall string")
    near = vectors.top_k(questions, memory, 50)
    index = hybrid.postings(memory)
    got = {(r["query_id"], r["item_id"]): r for r in hybrid.rerank(questions, near, memory, index).collect()}
    base = {(r["query_id"], r["item_id"]): r["score"] for r in near.collect()}
    keys = {"ukulele", "strings", "two", "weeks"}
    for i, r in enumerate(sorted(memory.collect(), key=lambda r: r["item_id"])):
        text = (r["text"] or "").lower()
        overlap = len(keys & set(text.split())) / 4
        dated = max(0.0, 0.4 * (1 - abs((r["date"] - DAY + datetime.timedelta(days=14)).days) / 5))
        hall = {"a": 0.25, "b": 0.10}.get(r["hall"], 0.0)
        want = 1 - base[1, i]
        for boost in (0.3 * overlap, 0.6 * ("ukulele strings" in text), 0.4 * ("rachel" in text), dated, hall):
            want *= 1 - boost
        assert got[1, i]["overlap"] == pytest.approx(overlap) and got[1, i]["fused"] == pytest.approx(want, abs=1e-8)
        assert got[2, i]["fused"] == pytest.approx(1 - base[2, i], abs=1e-8)
    ranks = sorted((r["fused"], i) for (q, i), r in got.items() if q == 1)
    assert [got[1, i]["rank"] for _, i in ranks] == list(range(1, 8))
    rare = hybrid.rerank(questions, near, memory, index, hybrid.frequencies(index)).where("query_id = 1 AND item_id = 2").first()
    assert 0 < rare["overlap"] < 0.5 or rare["overlap"] != 0.5


def test_stored_index_is_the_same(spark, memory, tmp_path):
    hybrid.write_index(memory, str(tmp_path))
    stored, df = hybrid.read_index(spark, str(tmp_path))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, hybrid.postings(memory).collect()))
    assert {r["term"]: r["df"] for r in df.collect()}["ukulele"] == 2
    plan = stored.where("term = 'ukulele'")._jdf.queryExecution().toString()
    assert "EqualTo(term,ukulele)" in plan


def cloud(spark, n, dim=16, seed=1, centers=20):
    pick = np.random.default_rng(seed)
    middle = pick.normal(size=(centers, dim))
    rows = [(int(i), (middle[i % centers] + 0.5 * pick.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(n, [0.0] * dim), (n + 1, rows[0][1]), (n + 2, None)]
    return spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(6)


def test_certified_search_is_exact_and_few_probes_recall(spark):
    items = cloud(spark, 3000)
    queries = items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    index = ivf.build(items, 40)
    assert index.rows.count() == 3002 and index.radius.agg(F.sum("n")).first()[0] == 3002
    want = {(r["query_id"], r["item_id"], r["rank"]) for r in vectors.top_k(queries, items, 10).collect()}
    sure = {(r["query_id"], r["item_id"], r["rank"]) for r in ivf.search(queries, index, 10, 2, certified=True).collect()}
    assert sure == want
    some = {(r["query_id"], r["item_id"]) for r in ivf.search(queries, index, 10, 8).collect()}
    assert len(some & {x[:2] for x in want}) / len(want) >= 0.9


def test_index_survives_storage_and_odd_tables(spark, tmp_path):
    items = cloud(spark, 300)
    index = ivf.build(items, 10)
    index.write(str(tmp_path))
    again = ivf.Index.read(spark, str(tmp_path))
    queries = items.where("item_id < 9").withColumnRenamed("item_id", "query_id")
    a, b = (sorted(map(tuple, ivf.search(queries, x, 5, 3).collect())) for x in (index, again))
    assert a == b and len(a) == 45
    empty = ivf.build(items.limit(0), 10)
    assert ivf.search(queries, empty, 5).collect() == []
    assert ivf.search(queries.limit(0), index, 5, certified=True).collect() == []


@pytest.mark.parametrize("group", [None, "g"])
def test_few_queries_and_many_agree(spark, monkeypatch, group):
    pick = random.Random(2)
    rows = [(i, [float(pick.randint(0, 3)) for _ in range(4)], pick.choice(["a", "b", "c", None])) for i in range(400)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>, g string").repartition(5)
    queries = items.where("item_id % 7 = 0").withColumnRenamed("item_id", "query_id")
    few = sorted(map(tuple, vectors.top_k(queries, items, 6, group=group, min_score=0.1).collect()))
    monkeypatch.setattr(vectors, "FEW_BYTES", 0)
    assert few == sorted(map(tuple, vectors.top_k(queries, items, 6, group=group, min_score=0.1).collect()))


def test_embed_takes_few_texts_at_a_time(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from loci.functions import vectors

    seen, scatter = [], vectors._scatter
    monkeypatch.setattr(vectors, "EMBED_ROWS", 3)
    monkeypatch.setattr(vectors, "_scatter", lambda words, codes: (seen.append(len(words)), scatter(words, codes))[1])
    texts = ["a b a", None, "", "é b", "c " * 50, "A", "x y z"]
    rows = pa.array([None, *[None if t is None else t.lower().split() for t in texts]], pa.list_(pa.string())).slice(1)
    codes = vectors._Codes(384)
    got = np.concatenate([vectors._scatter(rows.slice(at, 3), codes) for at in (0, 3, 6)])
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(384)
        for w in (t or "").lower().split():
            code = vectors.token_code(w, 384)
            want[abs(code) - 1] += np.sign(code)
        assert np.allclose(v, want / (np.linalg.norm(want) or 1), atol=1e-7)
    assert seen == [3, 3, 1]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(vectors.embed(F.col("t")).alias("v"))
    assert df.schema["v"].dataType.simpleString() == "array<float>"
    assert np.array_equal(np.array([r["v"] for r in df.collect()], np.float32), got)
