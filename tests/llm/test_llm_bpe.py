"""BPE coding against the tokenizers library, whole tables and odd texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loci.llm import bpe
from loci.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(NAME))


@pytest.fixture(scope="module")
def mine():
    return bpe.Bpe(tokenizer_path(NAME))


def same(mine, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode([text.encode()])[0].tolist() == ids, text[:80]
    assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_pieces(mine, theirs):
    pick = random.Random(3)
    parts = [" ", " ", "\n", "\t", "\xa0", "　", "\x85", "\x1c", "'", "'s", "'ll", "a", "foo", "Bar", "é", "中", "1", "23", "!", "...",
             "<|endoftext|>", "<|endof", "​", "\U0001f600", "ͅ", "Ᲊ", "꟎"]
    for _ in range(4000):
        same(mine, theirs, "".join(pick.choice(parts) for _ in range(pick.randint(0, 14))))


def test_code_points(mine, theirs):
    pick = random.Random(4)
    for _ in range(2000):
        some = [chr(pick.choice([pick.randrange(0x250), pick.randrange(0x300, 0xD000), pick.randrange(0xE000, 0x33500)])) for _ in range(8)]
        same(mine, theirs, "".join(pick.choice([c, " ", "a", "1"]) for c in some))


def test_long_words(mine, theirs):
    pick = random.Random(5)
    for text in ["a" * 1000, "ab" * 3000, "xyz" * 400 + " " * 500 + "k", "\n" * 1000, " " * 3001 + "\n", "".join(pick.choice("abcdet") for _ in range(5000))]:
        same(mine, theirs, text)


def test_scan_and_heap_agree(mine):
    pick = random.Random(6)
    for _ in range(500):
        word = "".join(pick.choice("aeinst é") for _ in range(pick.randint(1, 60))).encode()
        sizes, ids = mine._scan([word, word[::-1]])
        assert ids.tolist() == mine._heap(word) + mine._heap(word[::-1]) and sizes[0] == len(mine._heap(word))


def test_forgetting_changes_nothing(mine, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "CELLS", 40)
    for k in range(30):
        same(mine, theirs, f"word{k} some, more. {'x' * 2000} {k}")


def test_broken_utf8_and_unknown_ids(mine, theirs):
    ids = theirs.encode("中é", add_special_tokens=False).ids
    for cut in ([*ids[:1]], [*ids[1:]], [*ids, 10**6], []):
        assert mine.decode(cut) == theirs.decode(cut, skip_special_tokens=False)


def test_query(spark, theirs):
    rows = QUERIES["op11_bpe_codec"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in docs:
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in rows} == want and len(rows) == len(docs)


def test_nulls_repeats_clashes_and_empty(spark):
    path = tokenizer_path(NAME)
    docs = spark.createDataFrame([(1, None, 7, "x"), (1, None, 7, "x"), (None, "", 8, None), (2, "a b" * 9, 9, "y")], "doc_id long, text string, ids int, Decoded string")
    found = bpe.coded(docs, path)
    assert found.columns == ["doc_id", "text", "ids", "Decoded", "_ids", "_decoded"]
    rows = found.collect()
    assert sorted(r["_decoded"] for r in rows) == ["", "", "", "a b" * 9] and {r["ids"] for r in rows} == {7, 8, 9}
    assert bpe.digested(bpe.coded(docs.select("doc_id", "text").limit(0), path)).count() == 0
    back = docs.select("text", bpe.decode(bpe.encode(F.col("text"), path), path).alias("t")).collect()
    assert all((r["text"] or "") == r["t"] for r in back)
    assert docs.select(bpe.decode(F.lit(None).cast("array<int>"), path).alias("t")).where("t is null").count() == 4
