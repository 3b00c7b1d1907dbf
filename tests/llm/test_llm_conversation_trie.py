"""The conversation trie against brute force, with few and many shards."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from loci.llm import conversation_trie
from loci.llm.common import prepare

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                children[tuple(ts[: d - 1])].add(tuple(ts[:d]))
        ends[tuple(ts)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children[p]
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def found(df, shard_turns):
    out = conversation_trie.shared_prefixes(df, shard_turns)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def made(seed, convs, wordings, longest):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(pick.randint(1, longest)):
            rows.append((c, t, pick.choice(["user", "assistant", None]), pick.choice(wordings)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [3, 40, 400_000])
def test_nodes(spark, shard_turns):
    rows = made(1, 160, ["a", "b", None, "中文 text"], 9)
    rows += [(500 + i, t, "user", "hot") for i in range(60) for t in range(3)]  # equal conversations
    rows += [(900, t, "user", f"long {t % 3}") for t in range(700)]  # one long conversation, and one that begins like it
    rows += [(901, t, "user", f"long {t % 3}") for t in range(650)] + [(1000, None, "user", "first"), (1000, 3, None, None), (1000, 3, None, None)]
    rows += [(None, 1, "user", "nobody's"), (1101, 0, "user", "no lender"), (-5, 0, "user", "below"), (1200, 0, "ab", "c"), (1300, 0, "a", "bc")]
    df = prepare(spark).createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, seq string, n int").repartition(6)
    assert found(df, shard_turns) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_many_shards(spark, seed):
    rows = made(10 + seed, 250, ["a", "b"], 6)
    assert found(prepare(spark).createDataFrame(rows, SCHEMA).repartition(4), 25) == brute(rows)


def test_one_conversation_of_one_turn_and_nothing(spark):
    df = prepare(spark).createDataFrame([(7, 0, "user", "hi")], SCHEMA)
    assert found(df, 10) == brute([(7, 0, "user", "hi")])
    assert found(df.limit(0), 10) == []


def test_pieces_stream(spark, monkeypatch):
    """A name with many members is digested from pieces in order."""
    df = prepare(spark).range(30_000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 50 AS STRING)) AS name", "id AS conv_id").repartition(8)
    want = defaultdict(list)
    for r in df.collect():
        want[r["name"]].append(r["conv_id"])
    got = {r["name"]: r["ends_sha256"] for r in conversation_trie.ends_digests(df).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_tree_is_balanced_and_ordered():
    sequences = [([i], [1], 1, i, str(i)) for i in range(1000)]
    tree = conversation_trie.build(sequences)
    height = {-1: 0}
    for at in range(len(tree.turn) - 1, 0, -1):
        height[at] = 1 + max(height[tree.low[at]], height[tree.high[at]])
    assert height[tree.equal[0]] <= 11
    assert [tree.turn[at] for at in tree.walk()[1:]] == list(range(1000))
