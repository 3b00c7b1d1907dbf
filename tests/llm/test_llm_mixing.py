from collections import defaultdict

import numpy as np
import pytest

from loci.llm import mixing as m
from loci.llm.common import prepare


def water(sizes, weights, most=3):
    """Targets by the loop that the closed form replaces."""
    total, open_ = float(sum(sizes)), set(range(len(sizes)))
    target, left = [0.0] * len(sizes), total
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ -= over
    return target


def first_fit(units, gap):
    """Documents (place, size, words) that fit one after the other."""
    took = set()
    for place, size, words in sorted(units):
        if words <= gap:
            took.add((place, size))
            gap -= words
    return took


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    draw = np.random.default_rng(2)
    rows = []
    for i in range(600):
        source = ["big", "b", "c", "é", None, "tiny"][int(draw.choice(6, p=[0.5, 0.2, 0.15, 0.1, 0.04, 0.01]))]
        rows.append((i, " ".join(["w"] * int(draw.integers(0, 60))), source))
    rows += [(600, None, "c"), (601, "", "tiny"), (None, "a b c", "b"), (5, rows[5][1], rows[5][2]), (602, "x " * 30_000, "big"), (603, None, "nothing")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS whole", "2 AS cut", "3 AS s", "4 AS size")


def test_targets_and_taken(docs):
    got = m.taken(docs).collect()
    assert len(got) == docs.count()
    assert sorted(map(str, got)) == sorted(map(str, m.taken(docs).collect()))
    sizes, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    want = water([sizes[n] for n in names], [i % 3 + 1 for i in range(len(names))])
    assert [target[n] for n in names] == pytest.approx(want)
    smallest = {n: min([r["size"] for r in got if r["source"] == n and r["size"]], default=0) for n in names}
    for n in names:
        assert abs(taken[n] - target[n]) <= max(smallest[n], 1) + 1
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))


def test_mixed_repeats_rows(docs):
    out = m.mixed(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"], r["source"]] += len((r["text"] or "").split())
    taken = defaultdict(int)
    for r in m.taken(docs).collect():
        taken[r["doc_id"], r["source"]] += r["taken"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


def test_one_source_and_empty(spark, docs):
    one = docs.where("source = 'b'")
    assert all(r["taken"] == r["size"] for r in m.taken(one).collect())
    assert m.taken(docs.limit(0)).count() == 0 and m.mixed(docs.limit(0)).count() == 0
    blank = docs.where("doc_id = 603")
    assert [r["taken"] for r in m.taken(blank).collect()] == [0]


@pytest.mark.parametrize("fold", [0, 5, 2000])
def test_first_fit(spark, fold):
    draw = np.random.default_rng(4)
    rows = [(n, f"{int(draw.integers(16**6)):06x}", int(size), int(size * copies))
            for n in range(5) for size, copies in zip(draw.choice([0, 1, 3, 7, 40, 900], 400), draw.choice([1, 1, 1, 2], 400))]
    rows += [(9, "abc", 100, 100)]
    gaps = {0: 0, 1: 777, 2: 13_000, 3: 10**7, 4: 1, 9: 60}
    units = spark.createDataFrame([("", n, *r) for n, *r in rows], "s string, none int, place string, size long, words long").dropDuplicates(["none", "place"])
    found = {r["none"]: r for r in m.first_fit(units, spark.createDataFrame([("", n, g) for n, g in gaps.items()], "s string, none int, gap long"), fold).collect()}
    held = units.where("words > 0").collect()
    for n, gap in gaps.items():
        mine = [tuple(r)[2:] for r in held if r["none"] == n]
        r = found[n]
        took = {(p, s) for p, s, w in mine if any(w <= x["most"] and (p, s) <= tuple(x["cut"]) for x in r["steps"]) or (p, s) in map(tuple, r["picks"])}
        assert took == first_fit(mine, gap)


@pytest.mark.parametrize("start", [0, 10_000, 50_000])
def test_one_long_document(spark, start):
    """2,000 documents of 100 words and one of 100,000: the fraction is met to within the smallest document."""
    rows = [(start + i, "w " * 100, "a") for i in range(2000)] + [(start + 2000, "w " * 100_000, "a"), (start + 2001, "v " * 150_000, "b")]
    got = m.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        off = abs(sum(r["taken"] for r in mine) - mine[0]["target"])
        assert off <= 100 if source == "a" else off <= 75_000
        assert all(r["taken"] <= 3 * r["size"] for r in mine)


def test_rows_repeated_throughout(spark):
    rows = [(i % 50, f"w{i % 50} " * (i % 50 + 1), "ab"[i % 2]) for i in range(300)] + [(None, f"n{i} x", "b") for i in range(200)]
    got = m.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 12
    assert len(got) == len(rows)
