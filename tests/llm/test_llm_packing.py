import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from loci.llm import packing as p
from loci.llm.common import prepare
from loci.llm.queries import tokenizer_path
from loci.llm.tokens import WordTokens

ODD = [None, "", "  ", "İI'M don't\u00a0x\u2003y é e\u0301 <|endoftext|> a<|startoftext|>b ß ΑΣ Σ \u0301x 12,34 a\x1cb\x85c\u2028d", "a" * 5000, "The the THE, the.", "😀 日本語 x" * 9]


def test_words_give_the_tokenizers_ids():
    whole = Tokenizer.from_file(tokenizer_path())
    words = WordTokens(tokenizer_path(), most=10)
    for _ in range(2):
        for text, ids in zip(ODD, words.encode([t if t is None else t.encode() for t in ODD]), strict=True):
            assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_packer_uses_every_id_once(seed):
    draw = np.random.default_rng(seed)
    sizes = [(i, int(x)) for i, x in enumerate(draw.integers(1, [40, 9000, 600][seed % 3], int(draw.integers(0, 80))))]
    packer = p.Packer()
    windows = packer.pack(sizes[: len(sizes) // 2]) + packer.pack(sizes[len(sizes) // 2 :])
    assert all(sum(b - a for _, a, b in w) in p.TIERS for w in windows)
    assert sum(x[0] for x in packer.pool) < p.TIERS[0]
    windows += packer.rest()
    spans = defaultdict(list)
    for window in windows:
        size = sum(b - a for _, a, b in window)
        assert size & (size - 1) == 0
        for doc, a, b in window:
            spans[doc].append((a, b))
    for doc, size in sizes:
        at = 0
        for a, b in sorted(spans[doc]):
            assert a == at and b > a
            at = b
        assert at == size
    steps = p.deal_steps(windows)
    for step in set(steps.tolist()):
        own = [sum(b - a for _, a, b in w) for w, s in zip(windows, steps, strict=True) if s == step]
        assert len(set(own)) == 1 and sum(own) <= p.STEP_TOKENS


def test_pieces_of_a_table(spark):
    prepare(spark)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20 + i, "some words of a text " * (30 * i)) for i in range(30)] + [(20, ""), (21, "some words of a text " * 30), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS start", "3 AS doc_row").repartition(3)
    pieces = p.packed(docs, tokenizer_path(), block_tokens=20_000)
    got = p.digested(pieces).collect()
    assert sorted(map(str, got)) == sorted(map(str, p.digested(p.packed(docs, tokenizer_path(), block_tokens=20_000)).collect()))
    whole = Tokenizer.from_file(tokenizer_path())
    docs_of, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs_of[r["doc_row"]].append(r)
        sequences[r["sequence_id"]].append(r)
    found = []
    for parts in docs_of.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == parts[0]["doc_tokens"]
        found.append((parts[0]["doc_id"], at))
    want = [(i, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == parts[0]["sequence_tokens"] <= 4096 and at & (at - 1) == 0
    one = next(r for r in got if r["doc_id"] == 5)
    ids = np.array([*whole.encode(ODD[5], add_special_tokens=False).ids, 2], "<u4")
    assert one["ids_crc32"] == zlib.crc32(ids[one["start"] : one["start"] + one["length"]].tobytes())
    assert p.packed(docs.limit(0), tokenizer_path()).count() == 0
