import numpy as np
import pyarrow as pa
import pytest

from loci.llm import quality_rules as q
from loci.llm.common import prepare

GOOD = "the cat sat on the mat and it was a good day for all of us. " * 1
DOC = "doc_id long, text string, lang string, source string, n_chars int"


def brute(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return [len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(twice)]


TEXTS = [
    None, "", "   \n\t ", "one", "a b c a b c", "a b a b a b a b", "x\ny\nx\n\n\nx", "é#è $% <b>| & z  q\x1cw", "w " * 300,
    "l1 a\nl1 a\n l1 a\nl2", "a b c d\va b c\fa b", "zz " * 2 + "q r s " * 3,
]


def test_figures_match_brute_force():
    got = q.figures_of(pa.array(TEXTS, pa.string())).to_pylist()
    for text, row in zip(TEXTS, got, strict=True):
        assert [row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute(text), text


def test_figures_of_a_slice_and_of_many_words():
    column = pa.array(TEXTS, pa.string())
    assert q.figures_of(column.slice(4, 3)).to_pylist() == q.figures_of(column).to_pylist()[4:7]
    ids = np.random.default_rng(3).integers(0, 40, 500)
    assert q._repeat_words(ids, True) == q._repeat_words(ids, False)


def test_em_finds_the_bad_class():
    draw = np.random.default_rng(5)
    good = draw.random(4000) < 0.8
    chance = np.array([[0.01, 0.2, 0.79], [0.02, 0.68, 0.3], [0.05, 0.05, 0.9]])
    bad = np.array([[0.7, 0.2, 0.1], [0.5, 0.4, 0.1], [0.4, 0.2, 0.4]])
    votes = np.array([[draw.choice([-1, 0, 1], p=(chance if g else bad)[r]) for r in range(3)] for g in good])
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = q.fit_counts(patterns, counts.astype(float))
    assert abs(model.good - good.mean()) < 0.05
    odds = np.log(model.good / (1 - model.good)) + sum(
        np.log(np.array(model.of_good[r])[votes[:, r] + 1] / np.array(model.of_bad[r])[votes[:, r] + 1]) for r in range(3))
    assert ((odds > 0) == good).mean() > 0.9
    assert all(a > 0.45 and b > 0.45 for a, b in model.accuracies()[:2])


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i, f"{GOOD} story number {i} of the many that we have in the big book of the old house by the sea. And then it was over, so "
                f"the man went to the town with a dog, and for the rest of the year{i} he was there on his own, but not sad at all.", "en", "s", 1)
            for i in range(60)]
    rows += [(100 + i, " ".join(f"Wort{i}{k}$$$ %%%" for k in range(80)), "en", "s", 1) for i in range(6)]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (None, GOOD * 5, "en", "s", 1), (0, rows[0][1], "en", "s", 1)]
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS figures", "2 AS F", "3 AS p_good")


def test_judge_and_keep(docs):
    got = {r["doc_id"]: r for r in q.judge(docs).collect()}
    assert got[5]["kept"] and not got[5]["base_failed"]
    assert not got[101]["kept"] and not got[101]["base_failed"]
    assert got[200]["base_failed"] and got[201]["base_failed"] and not got[200]["kept"]
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted([0, *range(60)])


def test_empty_table(spark, docs):
    assert q.judge(docs.limit(0)).count() == 0
    assert q.keep_good(docs.limit(0)).count() == 0
