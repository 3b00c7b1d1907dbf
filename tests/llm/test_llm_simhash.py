import numpy as np
import pytest
import xxhash

from loci.llm import simhash as s
from loci.llm.common import prepare
from loci.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "A b", "a B c", "A b C d a b c d a b c", "É x y z " * 40, "w" * 5000])
def test_fingerprint(text):
    assert s.fingerprint_of(None if text is None else text.encode()) == brute_print(text)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("bucket", [8192, 8])
def test_links_keep_all_components(spark, bucket):
    prepare(spark)
    draw = np.random.default_rng(bucket)
    base = [int(x) for x in draw.integers(0, 1 << 63, 6)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:  # dense clouds and chains around each
        at = b
        for _ in range(25):
            for _ in range(int(draw.integers(1, 5))):
                at ^= 1 << int(draw.integers(0, 64))
            prints.add(at)
            prints.add(b ^ (1 << int(draw.integers(0, 64))) ^ (1 << int(draw.integers(0, 64))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in s.links(frame, bucket).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    truth = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    assert roots(prints, edges) == roots(prints, truth)


def test_components_of_paths_and_stars(spark):
    prepare(spark)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 400), (400, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e if e[0] != e[1]}, edges)
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    other = {}
    for node, root in want.items():
        other.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text.upper()), (9, "other text entirely with its own words"), (None, text), (7, None), (8, " "), (9, "other text entirely with its own words"), (11, "z" * 100_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS key", "3 AS digest", "4 AS turn")


def test_near_duplicates_and_keep_first(spark):
    prepare(spark)
    docs = documents(spark)
    got = sorted(((r["doc_id"], r["component_id"], r["fingerprint"]) for r in s.near_duplicates(docs).collect()), key=str)
    assert len(got) == 8
    named = {d: c for d, c, _ in got}
    assert named == {5: 3, 3: 3, 9: 9, None: 3, 7: 7, 8: 7, 11: 11}
    assert {f for d, _, f in got if d in (7, 8)} == {"0" * 16}
    kept = s.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 9, 11]
    assert s.near_duplicates(docs.limit(0)).count() == 0 and s.keep_first(docs.limit(0)).count() == 0


def test_only_null_ids(spark):
    prepare(spark)
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert s.keep_first(docs).count() == 2
    assert {r["component_id"] for r in s.near_duplicates(docs).collect()} == {None}
