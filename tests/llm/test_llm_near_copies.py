import random

import pytest

from loci.llm import near_copies as n
from loci.llm.common import prepare


def truth(texts):
    """The least position of each text's group, by all pairs."""
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    grams = []
    for t in texts:
        w = (t or "").lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted({find(i) for i in range(len(texts))})


@pytest.mark.parametrize("bucket", [2048, 8])
def test_keep_first_against_all_pairs(spark, bucket):
    prepare(spark)
    draw = random.Random(bucket)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(draw.randrange(40, 400))]
        texts.append(" ".join(base))
        for _ in range(10):  # copies with single words replaced, some of them copies of copies
            copy = base[:]
            for _ in range(draw.randrange(1, max(2, len(base) // 40))):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy if draw.random() < 0.3 else base
        texts.append(" ".join(base[: int(len(base) * 0.75)]))
        texts.append(" ".join(base).upper())
    texts += [None, "", " \n", "a b", "A  b", "a c", " ".join(word() for _ in range(20_000))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS key", "3 AS digest", "4 AS turn").repartition(3)
    kept = n.keep_first(docs, bucket)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == truth(texts)


def test_no_ids_repeats_and_empty(spark):
    prepare(spark)
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None), (4, "x"), (4, "x")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in n.keep_first(docs).where("text IS NOT NULL").collect()) == [("4", "x"), ("None", "a b c d")]
    assert n.keep_first(docs).count() == 3 and n.keep_first(docs.limit(0)).count() == 0


def test_fingerprints_find_what_shares_no_minima(spark):
    prepare(spark)
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(f"v{i}" for i in range(300))]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    rows = []
    for i, text in enumerate(texts):
        found = n.shingles(text.encode())
        sketch = n.sketch_of(n.minima(found))
        # Keys that nothing shares: the pair can only meet by its fingerprints.
        rows.append((signed(n.name_of(found)), len(found), signed(n.print_of(found)), bytearray(sketch), [100 * i + b for b in range(n.BANDS)], text))
    assert (rows[0][2] ^ rows[1][2]).bit_count() <= 3
    own = spark.createDataFrame(rows, "fp long, size long, print long, sketch binary, bands array<long>, text string")
    own = own.selectExpr("* EXCEPT (text)", "xxhash64(text) AS digest")
    found = n.links(own, spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [{r["a"], r["b"]} for r in found.collect()] == [{rows[0][0], rows[1][0]}]
