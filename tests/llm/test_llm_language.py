import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loci.llm import language_id as li
from loci.llm.common import prepare

LANGS = {"aa": "kalo mira tesu vani ropo", "bb": "schtrum gruft zwark plonz", "cc": "ión está año más niño"}


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    draw = random.Random(3)
    rows = []
    for i in range(240):
        lang = sorted(LANGS)[i % 3]
        words = LANGS[lang].split()
        made = [draw.choice(words) if draw.random() < 0.6 else "".join(draw.choice(words)[:3] for _ in range(2)) for _ in range(draw.randrange(3, 30))]
        rows.append((i, " ".join(made).capitalize() + ".", lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 ½ --- !!", "cc"), (903, "mira tesu", None), (None, "schtrum", "bb"), (5, rows[5][1], rows[5][2]), (904, "kalo " * 40_000, "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS p", "2 AS score", "3 AS word")


def identify(docs):
    return li.identify(docs, F.col("doc_id").isNotNull() & ~li.held_out(F.col("doc_id")))


def test_held_out_fold(docs):
    for r in docs.select("doc_id", li.held_out(F.col("doc_id")).alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_predictions(docs):
    got = identify(docs).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([by[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    for i in (900, 901, 902):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[903]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and by[904]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, identify(docs.select("doc_id", "text", "lang")).collect()))


def test_counts_and_word_scores(spark, docs):
    training = docs.where("lang IS NOT NULL AND doc_id < 100")
    want = Counter((r["lang"], w) for r in training.collect() for w in li._LETTERS.findall((r["text"] or "").lower()))
    counts = li.word_counts(training)
    assert {(r["lang"], r["word"]): r["n"] for r in counts.collect()} == dict(want)
    grams = Counter()
    for (lang, word), n in want.items():
        marked = f"^{word}$"
        for k in li.ORDERS:
            for i in range(max(1, len(marked) - k + 1)):
                grams[lang, marked[i : i + k]] += n
    assert {(r["lang"], r["gram"]): r["n"] for r in li.gram_counts(counts).collect()} == dict(grams)
    model = li.fit(training)
    total, kinds = sum(n for (lang, _), n in want.items() if lang == "aa"), len({w for _, w in want})
    kalo = {r["word"]: r["scores"] for r in model.words.collect()}["kalo"]
    assert kalo[0] == pytest.approx(1e6 * math.log((want["aa", "kalo"] + 0.5) / (total + 0.5 * kinds)), abs=1)
    assert model.words.count() == kinds and model.grams.count() == len({g for _, g in grams})


def brute(rows, training):
    """Predictions in plain Python: everything counted, scores in whole millionths."""
    words = Counter((lang, w) for _, text, lang in training for w in li._LETTERS.findall((text or "").lower()))
    langs = sorted({lang for lang, _ in words})

    def grams_of(w, k):
        marked = f"^{w}$"
        return [marked[i : i + k] for i in range(max(1, len(marked) - k + 1))]

    grams = Counter()
    for (lang, w), n in words.items():
        for k in li.ORDERS:
            for g in grams_of(w, k):
                grams[lang, g] += n

    def table(counts):
        totals, names = Counter(), sorted({x for _, x in counts})
        for (lang, _), n in counts.items():
            totals[lang] += n
        bottom = {lang: math.log(totals[lang] + 0.5 * len(names)) for lang in langs}
        return {x: [round((math.log(counts[lang, x] + 0.5) - bottom[lang]) * 1e6) for lang in langs] for x in names}, totals

    by_word, totals = table(words)
    by_gram, _ = table(grams)

    def score(w):
        if w in by_word:
            return by_word[w]
        for k in li.ORDERS:
            known = [by_gram[g] for g in grams_of(w, k) if g in by_gram]
            if known:
                return [math.floor(sum(c) / len(known) + 0.5) for c in zip(*known)]
        return [0] * len(langs)

    out = []
    for name, text, _ in rows:
        found = li._LETTERS.findall((text or "").lower())
        if not found:
            out.append((name, "und", 0.0))
            continue
        total = [round(math.log(totals[lang] / sum(totals.values())) * 1e6) for lang in langs]
        for w, n in Counter(found).items():
            total = [t + n * s for t, s in zip(total, score(w))]
        best = max(total)
        out.append((name, langs[total.index(best)], 1 / sum(math.exp((t - best) / 1e6) for t in total)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [0, 4, 100_000])
def test_whole_predictions(spark, docs, head):
    """Whatever is broadcast, every counted word and n-gram takes part."""
    more = spark.createDataFrame([(1000 + i, f"gruft{i} kalx{i % 7}q éé zz̈z 中文{i}", None) for i in range(40)], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(more)
    rows = [tuple(r) for r in every.collect()]
    training = [r for r in rows if r[0] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    learn = F.col("doc_id").isNotNull() & ~li.held_out(F.col("doc_id"))
    got = sorted((tuple(r) for r in li.identify(every, learn, head).collect()), key=repr)
    want = brute(rows, training)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-4)


def test_nothing_to_learn(docs):
    found = li.identify(docs, F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert identify(docs.limit(0)).count() == 0
