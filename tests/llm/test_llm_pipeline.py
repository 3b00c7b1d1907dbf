"""Each stage of the pipeline against plain Python on what the stage before gave."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from loci.llm.common import prepare
from loci.llm.queries import QUERIES, SQL, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"
COMMON = "the of and to in is that it for on with as was by this be are from or an at not have".split()


def prose(draw, n):
    words = [draw.choice(COMMON) if draw.random() < 0.4 else "".join(draw.choice(["ta", "re", "ni", "so", "ka", "lu"]) for _ in range(draw.randrange(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    prepare(spark)
    draw = random.Random(11)
    shared = prose(draw, 60)
    rows = []
    for i in range(120):
        text = prose(draw, draw.randrange(80, 200))
        if i % 10 == 0:
            text = f"{prose(draw, 30)} {shared} {prose(draw, 40)}"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    for i in range(12):
        junk = " ".join(f"{draw.choice(['zap', 'win', 'buy'])}{k}$$$" for k in range(90))
        rows.append((200 + i, junk, "en", "s1", len(junk)))
    rows += [(300 + i, rows[5][1], "en", "s2", rows[5][4]) for i in range(3)]
    for name, of, every in ((500, 7, 100), (501, 9, 7)):  # a near copy on either side of the line
        words = rows[of][1].split()
        for k in range(3, len(words), every):
            words[k] = f"new{k}"
        rows.append((name, " ".join(words), "en", "s3", len(" ".join(words))))
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, "too short", "en", "s0", 9), (5, rows[5][1], "en", "s1", rows[5][4])]
    path = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        tables.append(docs.collect())
    _, good, single, cleaned, mixed, pieces = tables

    assert sorted(r["doc_id"] for r in good) == sorted([*range(120), 300, 301, 302, 500, 501, 5])

    grams = {}
    for r in good:
        w = r["text"].lower().split()
        grams[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    parent = {i: i for i in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in grams:
        for b in grams:
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert find(500) == 7 and find(501) == 501
    assert sorted(r["doc_id"] for r in single) == sorted({find(i) for i in grams})

    words = {r["doc_id"]: r["text"].split() for r in single}
    count = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in cleaned:
        own = words[r["doc_id"]]
        gone = np.zeros(len(own), bool)
        for i in range(len(own) - 34):
            gone[i : i + 35] |= count[tuple(own[i : i + 35])] > 1
        assert r["text"].split() == [w for w, g in zip(own, gone, strict=True) if not g]
        assert r["n_chars"] == len(r["text"])
    assert len(cleaned) == len(single)

    sizes, took = defaultdict(int), defaultdict(int)
    times = Counter(r["doc_id"] for r in mixed)
    for r in cleaned:
        sizes[r["source"]] += len(r["text"].split())
        took[r["source"]] += times[r["doc_id"]] * len(r["text"].split())
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    total = sum(sizes.values())
    for s in sizes:  # no source is capped here
        target = total * weights[s] / sum(weights.values())
        assert target <= 3 * sizes[s] and abs(took[s] - target) <= 200
    assert max(times.values()) <= 3

    tokenizer = Tokenizer.from_file(tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in mixed}
    rows = defaultdict(list)
    for p in pieces:
        rows[p["doc_row"]].append(p)
    assert Counter(v[0]["doc_id"] for v in rows.values()) == times
    for parts in rows.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(tokenizer.encode(text[parts[0]["doc_id"]], add_special_tokens=False).ids) + 1


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32"} <= set(got.columns) and got.count() > 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert {"pipeline", *QUERIES} <= set(names)
    assert {x.split("_")[0] for x in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(SQL) <= set(QUERIES)
