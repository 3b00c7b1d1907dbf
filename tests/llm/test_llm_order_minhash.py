import hashlib
import random

import numpy as np
import pytest

from loci.llm import order_minhash as o
from loci.llm.common import prepare


def brute(text):
    """Signature by plain Python: occurrence-numbered k-mers, the least of each bin, in text order."""
    codes = [ord(c) for c in text]
    if not codes:
        return [0] * o.SKETCHES
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    width, base = min(o.K, len(codes)), 0x9E3779B97F4A7C15
    seen, items = {}, []
    for i in range(len(codes) - width + 1):
        gram = 0
        for c in codes[i : i + width]:
            gram = (gram * base + c + 1) & mask
        value = mix(gram) >> 24
        nth = seen[value] = seen.get(value, -1) + 1
        items.append((mix((value + nth * base) & mask) >> 24 if nth else value, i))
    out = []
    for b in range(o.SKETCHES):
        least = sorted(x for x in items if x[0] >> (40 - o.SKETCH_BITS) == b)[: o.TUPLE]
        least.sort(key=lambda x: x[1])
        digest = 0
        for j in range(o.TUPLE):
            digest = mix((digest * base + (least[j][0] if j < len(least) else 0) + 1) & mask)
        out.append((digest >> 32) | 1 if least else 0)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcde", "abcdef", "aaaaaaaaaaaaaaaaaaaa", "the quick brown fox " * 9, "é😀日本 語" * 7])
def test_sketch(text):
    assert o.sketch(o._codes(text)).tolist() == brute(text)


def test_order_counts():
    draw = random.Random(1)
    words = [f"word{draw.randrange(900)}" for _ in range(400)]
    text = " ".join(words)
    near = " ".join(w if draw.random() > 0.02 else "edited" for w in words)
    moved = " ".join(words[200:] + words[:200])
    sketch = lambda t: o.sketch(o._codes(t))
    assert o.likeness(sketch(text), sketch(text)) == 1.0
    assert o.likeness(sketch(text), sketch(near)) > 0.5
    assert o.likeness(sketch(text), sketch(moved)) < 0.9
    assert o.likeness(sketch(text), sketch("something else entirely, at some length")) < 0.1
    assert o.likeness(sketch(""), sketch("")) == 1.0 and o.likeness(sketch(""), sketch("x")) == 0.0


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_next_document(spark, tasks):
    prepare(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    draw = random.Random(tasks)
    rows = [(7 * i, "".join(draw.choice("ab é😀\n") for _ in range(draw.randrange(0, 30)))) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, "z" * 50_000), (-3, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS span", "2 AS guard", "3 AS digest")
    got = {r["doc_id"]: r for r in o.neighbours(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows.sort(key=lambda r: r[0])
    assert len(got) == len(rows)
    for i, (name, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[name]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) < 1000:
            own, other, nxt = (np.array(brute(t), np.uint32) for t in (text, edited, after[:1000]))
            assert r["fingerprint"] == o._hex(own) and r["edited_fingerprint"] == o._hex(other)
            assert r["near_edited"] == pytest.approx(o.likeness(own, other))
            if len(after) < 1000:
                assert r["near_next"] == pytest.approx(o.likeness(own, nxt))


def test_repeats_nulls_and_empty(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "other"), (None, "n"), (None, None)], "doc_id long, text string")
    assert o.neighbours(docs).count() == 5
    one = o.neighbours(docs.where("text = 'other'")).first()
    assert one["near_next"] == 1.0
    assert o.neighbours(docs.limit(0)).count() == 0
