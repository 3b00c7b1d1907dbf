"""Radix sort and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loci.llm import radix, resampling
from loci.llm.common import prepare


@pytest.mark.parametrize("bits,block_bits", [(16, 18), (4, 3), (8, 5)])
def test_ranks(spark, bits, block_bits):
    prepare(spark)
    pick = random.Random(bits)
    rows = [(pick.choice([5, 5, 5, 70_000, 2]), pick.choice([-(1 << 62), -1, 0, 3, 1 << 40, (1 << 63) - 1]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a long, b long, at long").repartition(5)
    found = radix.ranked(df, [F.col("a"), radix.unsigned(F.col("b"))], bits=bits, block_bits=block_bits)
    assert found.columns == ["a", "b", "at", "rank"]
    got = sorted(found.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 701)) and sorted(r["at"] for r in got) == list(range(700))
    assert [(r["a"], r["b"]) for r in got] == sorted((a, b) for a, b, _ in rows)


def test_later_keys_stay_in_order(spark):
    """A pass keeps the order of the pass before: all but one digit agree."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"))
    got = radix.ranked(df, [F.lit(3).cast("bigint"), F.col("a")], bits=4, block_bits=6).collect()
    assert all(r["rank"] == r["a"] + 1 for r in got)


def test_ranks_of_equal_and_no_rows(spark):
    df = spark.range(50).select(F.lit(4).cast("bigint").alias("a"))
    assert sorted(r["rank"] for r in radix.ranked(df, [F.col("a")]).collect()) == list(range(1, 51))
    assert radix.ranked(df.limit(0), [F.col("a")]).collect() == []


def brute(docs, target, runs=(1, 1), buckets=resampling.BUCKETS, min_words=20, percent=10, seed=2024):
    def words(text):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(runs[0], runs[1] + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for name, text in docs:
        f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append([name, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {}
    for i, r in enumerate(fit[: percent * len(fit) // 100], 1):
        drawn.setdefault((r[0], r[1], r[2], r[3]), []).append(i)
    return sorted([(*r[:4], drawn[tuple(r[:4])].pop(0) if drawn.get(tuple(r[:4])) and r[4] else None) for r in out], key=repr)


def texts(n, seed):
    pick = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma3", "été", "中文", "x-y", "don't", "A.B", "\x85nel", "q"]
    return [(i - 20, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([0, 3, 19, 20, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("runs,percent", [((1, 1), 10), ((1, 2), 50), ((2, 3), 100)])
def test_draw(spark, runs, percent):
    docs = texts(300, 1) + [(None, "word " * 30), (None, None), (7, None), (8, ""), (9, "tie " * 25), (9, "tie " * 25), (10, "long " * 100_000)]
    target = ["alpha beta alpha gamma3 " * 5, None, "中文 q"]
    df = prepare(spark).createDataFrame([(*d, "extra", 3) for d in docs], "doc_id long, text string, score string, rank int").repartition(7)
    found = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), runs=runs, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute(docs, target, runs, percent=percent)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resampled(none, docs.select("text")).collect() == []
    assert resampling.resampled(docs, none.select("text"), percent=100).collect()[0]["rank"] == 1
    assert resampling.resampled(docs, none.select("text"), percent=0).collect()[0]["rank"] is None
