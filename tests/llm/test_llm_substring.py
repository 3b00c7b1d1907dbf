import hashlib
from collections import Counter

import numpy as np
import pytest

from loci.llm import substring_dedup as sd
from loci.llm.common import prepare
from loci.llm.fm_index import FMIndex, repeated_windows, suffix_order


def test_suffix_order():
    draw = np.random.default_rng(0)
    for _ in range(40):
        text = np.concatenate([np.append(draw.integers(1, 4, int(draw.integers(0, 12))), 0) for _ in range(4)])
        ends = {int(p): -len(text) + k for k, p in enumerate(np.flatnonzero(text == 0))}
        keys = [[ends.get(j, int(text[j])) for j in range(i, len(text))] for i in range(len(text))]
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=keys.__getitem__)


def test_backward_search_counts():
    draw = np.random.default_rng(1)
    text = np.append(draw.integers(1, 5, 300), 0)
    index = FMIndex(text)
    for size in (1, 2, 4):
        for at in range(0, 200, 7):
            pattern = text[at : at + size]
            low, high = np.array([0]), np.array([index.size])
            for symbol in pattern[::-1]:
                low, high = index.extend(np.array([symbol]), low, high)
            assert high[0] - low[0] == sum((text[i : i + size] == pattern).all() for i in range(len(text) - size + 1))


@pytest.mark.parametrize("seed", range(60))
def test_repeated_windows(seed):
    draw = np.random.default_rng(seed)
    length, letters = int(draw.integers(2, 7)), int(draw.integers(1, 5))
    parts = [draw.integers(1, letters + 1, int(draw.integers(length, length + 20))) for _ in range(int(draw.integers(1, 10)))]
    if seed % 2:
        parts.append(parts[0].copy())
    text = np.concatenate([np.append(p, 0) for p in parts])
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    got = repeated_windows(FMIndex(text), text, starts, np.array([len(p) - length + 1 for p in parts]), length)
    windows = [tuple(p[i : i + length]) for p in parts for i in range(len(p) - length + 1)]
    count = Counter(windows)
    assert got.tolist() == [count[w] > 1 for w in windows]


def brute(texts, length):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append((len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "shard"), [(2000, 400_000), (1, 50), (3, 10)])
def test_removed_matches_brute_force(spark, hot, shard):
    prepare(spark)
    draw = np.random.default_rng(hot)
    said = [f"w{i}" for i in range(50)]
    passage = [said[i] for i in draw.integers(0, 50, 60)]
    texts = []
    for i in range(40):
        own = [said[j] for j in draw.integers(0, 50, int(draw.integers(0, 80)))]
        at = int(draw.integers(0, len(own) + 1))
        if i % 3 == 0:
            a, b = sorted(draw.integers(0, 60, 2))
            own[at:at] = passage[a:b]
        texts.append(" \n".join(own) if i % 2 else "\t".join(own))
    texts += [None, "", "  ", texts[0], "x y " * 60, "tok " * 700, texts[3]]
    ids = [*range(len(texts) - 1), 3]  # the last repeats a doc_id with its text
    rows = [(i, t, 1, 2) for i, t in zip(ids, texts, strict=True)] + [(None, texts[6], 1, 2), (3, "another text under a known id", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits int, digest int")
    got = sd.removed(docs, 10, gram=4, hot=hot, shard_words=shard).collect()
    want = brute([r[1] for r in rows], 10)
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=r[0], n_words=w[0], n_removed=w[1], kept_sha256=w[2])) for r, w in zip(rows, want, strict=True))


def test_default_length_and_columns(spark):
    prepare(spark)
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"start here {shared} end", 9), (2, f"{shared} tail", 9), (3, " ".join(f"p{i}" for i in range(34)), 9), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").selectExpr("*", "1 AS cleaned", "2 AS doc")
    out = sd.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: ("start here end", 14), 2: ("tail", 4), 3: (rows[2][1], 9), 4: (None, None)}
    assert sd.removed(docs.limit(0)).count() == 0 and sd.without_repeats(docs.limit(0)).count() == 0
