"""A prefix trie over conversations, with members, leaves and the text that sharing prefixes would save.

Turns are dictionary-encoded: equal (role, text) pairs, told by a SHA-256 of both, get one
number, in the order of their digests.  A conversation is then a row of numbers, 16 bytes a
turn.  Every conversation takes its first turns from another one where the caller's rule says
so.  Equal sequences collapse to one row with a count before anything else; distinct ones are
range-partitioned in lexicographic order into shards of about ``SHARD_TURNS`` turns.

Each shard puts its sequences into a ternary search tree, the median first and then the
medians of both halves, so the siblings of a node are balanced.  An iterative traversal adds
up members, leaves and savings from the bottom.  A node whose sequences lie in several
shards is on the last path of one and the first path of the next; how far two such
paths agree is known from the edges of the shards beforehand.  The first shard a node
occurs in counts the node itself, so the parts of a boundary node simply add up,
and only they are merged.

The digest of a node's ends is that of one text in one order, which cannot be cut; but the
ids are sorted and put into pieces of text by range, so a sequence with a third of all
conversations is sorted by many tasks and only its pieces stream through one.

Null roles and texts are empty.  Turns go by number, null first, equal numbers by digest;
repeated rows are turns of their own.  Rows without conv_id belong to no conversation and are
left out.  Long texts only enter their digest.  Other columns are not read.  An empty
table has no conversation and gives no node.  A conversation's numbers are one row, so its
turns are bounded by what a row holds (some ten million), its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loci.llm.common import crc32_sql, written
from loci.operators.skew import join_unique

SHARD_TURNS = 400_000
PIECE_CHARS = 1 << 16
BORROWED = 6  # turns taken from another conversation: crc32 of the id modulo this
EVERY = 100
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = (
    "prefix binary, parent_prefix binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends string"
)
_TYPES = [("prefix", pa.binary()), ("parent_prefix", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
          ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string())]


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: an array of (id, size), where id numbers distinct turns and size counts code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = written(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.sha2(name.cast("binary"), 256)).alias("key"), F.char_length(text).alias("size"),
    ), "turns")
    distinct = turns.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dictionary = written(distinct.repartitionByRange("key").sortWithinPartitions("key").select("key", "n", F.monotonically_increasing_id().alias("id")), "dictionary")
    numbered = join_unique(turns, dictionary, ["key"], "n")
    in_order = F.sort_array(F.collect_list(F.struct("turn", "id", "size")))
    return numbered.groupBy("conv_id").agg(in_order.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("seq"))


def rebuilt(sequences: DataFrame, borrowed: Column, lender: Column, most: int) -> DataFrame:
    """Sequences whose first ``borrowed`` (at most ``most``) turns are those of the conversation ``lender``."""
    heads = sequences.select(F.col("conv_id").alias("lender"), F.slice("seq", 1, most).alias("head"))
    wanted = sequences.withColumns({"lender": lender, "h": borrowed})
    none = F.slice("seq", 1, 0)
    own = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return wanted.join(heads, "lender", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("seq"))


class Tree:
    """A ternary search tree of sequences given in order; node 0 is the root of the trie and holds no turn."""

    def __init__(self):
        self.low, self.equal, self.high = [-1], [-1], [-1]
        self.turn, self.size, self.parent, self.depth = [-1], [0], [-1], [0]
        self.members, self.first, self.ends = [0], [None], [None]

    def _new(self, turn: int, size: int, parent: int) -> int:
        for column, value in (
            (self.low, -1), (self.equal, -1), (self.high, -1), (self.turn, turn), (self.size, size), (self.parent, parent),
            (self.depth, self.depth[parent] + 1), (self.members, 0), (self.first, None), (self.ends, None),
        ):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], sizes: list[int]) -> int:
        """The node of a sequence, made where it is not there yet."""
        low, equal, high, held = self.low, self.equal, self.high, self.turn
        at = 0
        for turn, size in zip(turns, sizes):
            links, owner, here = equal, at, equal[at]
            while here >= 0 and held[here] != turn:
                links, owner = (low, here) if turn < held[here] else (high, here)
                here = links[here]
            if here < 0:
                here = links[owner] = self._new(turn, size, at)
            at = here
        return at

    def walk(self) -> list[int]:
        """All nodes, parents before children and siblings in order."""
        out, waiting = [0], [self.equal[0]]
        while waiting:
            here = waiting.pop()
            if here >= 0:
                # The lower siblings come off first, then this node with all below it.
                waiting += [self.high[here], ~here, self.low[here]]
            elif here < -1:
                out.append(~here)
                waiting.append(self.equal[~here])
        return out


def build(sequences: list[tuple[list[int], list[int], int, int, str]]) -> Tree:
    """A balanced tree of ordered sequences (turns, sizes, count, smallest conv_id, name of the sequence)."""
    tree = Tree()
    ranges = [(0, len(sequences))]
    while ranges:
        a, b = ranges.pop()
        if a >= b:
            continue
        mid = (a + b) // 2
        turns, sizes, n, first, name = sequences[mid]
        at = tree.insert(turns, sizes)
        tree.members[at], tree.first[at], tree.ends[at] = n, first, name
        ranges += [(a, mid), (mid + 1, b)]
    return tree


def prefix_names(turns: list[int], upto: int) -> list[bytes]:
    """A digest for each of the prefixes of length 0 to ``upto``."""
    out = [b"root"]
    for turn in turns[:upto]:
        out.append(hashlib.sha256(out[-1] + turn.to_bytes(8, "little", signed=True)).digest())
    return out


def shard_nodes(sequences: list[tuple[list[int], list[int], int, int, str]], before: int, after: int) -> list[tuple]:
    """Rows of a shard's nodes; the first path is shared with the shard before to depth ``before``, the last with the next to ``after`` (-1: not even the root)."""
    tree = build(sequences)
    shared: dict[int, bytes] = {}
    not_ours: set[int] = set()
    for turns, upto, is_first in ((sequences[0][0], before, True), (sequences[-1][0], after, False)):
        if upto < 0:
            continue
        at = 0
        for depth, name in enumerate(prefix_names(turns, upto)):
            if depth:
                at = tree.equal[at]
                while tree.turn[at] != turns[depth - 1]:
                    at = tree.low[at] if turns[depth - 1] < tree.turn[at] else tree.high[at]
            shared[at] = name
            if is_first:
                not_ours.add(at)
    goes_on = {at for at in shared if tree.depth[at] == after == len(sequences[-1][0])}
    count = len(tree.turn)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    order = tree.walk()
    for at in reversed(order):
        if tree.equal[at] < 0 and at not in goes_on:
            leaves[at] += 1
        saved[at] += tree.size[at] * (tree.members[at] - (at not in not_ours))
        up = tree.parent[at]
        if up >= 0:
            tree.members[up] += tree.members[at]
            if tree.first[up] is None or tree.first[at] < tree.first[up]:
                tree.first[up] = tree.first[at]
            children[up] += at not in not_ours
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    rows = []
    for at in order:
        up = tree.parent[at]
        above = shared.get(up)
        rows.append((shared.get(at), above, tree.first[at], tree.depth[at], tree.first[up] if up >= 0 and above is None else None,
                     tree.members[at], children[at], leaves[at], saved[at], tree.ends[at]))
    return rows


def _shard(table: pa.Table) -> pa.Table:
    table = table.sort_by("place").combine_chunks()
    seq = table.column("seq").chunk(0)
    ids, sizes = seq.flatten().field("id").to_pylist(), seq.flatten().field("size").to_pylist()
    ends = (seq.offsets.to_numpy() - seq.offsets[0].as_py()).tolist()
    rest = [table.column(c).to_pylist() for c in ("n", "first", "name")]
    sequences = [(ids[a:b], sizes[a:b], *r) for a, b, *r in zip(ends, ends[1:], *rest)]
    rows = shard_nodes(sequences, table.column("before")[0].as_py(), table.column("after")[0].as_py())
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _TYPES, strict=True)], names=[n for n, _ in _TYPES])


def _edges(sharded: DataFrame) -> DataFrame:
    """For each shard, how deep its first path is that of the shard before and its last path that of the next; -1 where there is none."""
    # Whole numbers of shards only: one row for each SHARD_TURNS turns.
    shards = sharded.groupBy("shard").agg(F.max("place").alias("place"))
    in_order = Window.orderBy("shard")
    last = sharded.join(F.broadcast(shards.withColumn("next", F.lead("shard").over(in_order))), ["shard", "place"])
    last = last.select("shard", "next", F.col("seq").alias("last"))
    first = sharded.where("place = 0").select(F.col("shard").alias("next"), F.col("seq").alias("first"))
    agree = F.array_position(F.zip_with("last", "first", lambda a, b: a.eqNullSafe(b)), False) - 1
    met = written(last.join(first, "next").select("shard", "next", agree.alias("depth")), "edges")
    after, before = met.select("shard", F.col("depth").alias("after")), met.select(F.col("next").alias("shard"), F.col("depth").alias("before"))
    out = shards.select("shard").join(after, "shard", "left").join(before, "shard", "left")
    return out.select("shard", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Pieces of comma-joined conv_ids from sorted rows (name, conv_id)."""
    name, held, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["name", "first", "text"])

    for batch in batches:
        for one, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (one != name or size > PIECE_CHARS):
                yield piece()
                held, size = [], 0
            name = one
            held.append(conv)
            size += 20
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Digest of each name's pieces, which come together and in order."""
    name, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["name", "ends_sha256"])
        done.clear()
        return out

    for batch in batches:
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if one == name:
                state.update(b",")
            else:
                if state:
                    done.append((name, state.hexdigest()))
                name, state = one, hashlib.sha256()
            state.update(text.encode())
        if len(done) > 4096:
            yield flush()
    if state:
        done.append((name, state.hexdigest()))
        yield flush()


def ends_digests(members: DataFrame) -> DataFrame:
    """name and ends_sha256 of the conv_ids of each name in a table (name, conv_id)."""
    pieces = members.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_texts, "name string, first long, text string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").select("name", "text").mapInArrow(_digests, "name string, ends_sha256 string")


def trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of a table (conv_id, seq) of encoded conversations."""
    named = written(sequences.withColumn("name", F.sha2(F.array_join(F.col("seq.id").cast("array<string>"), ",").cast("binary"), 256)), "sequences")
    distinct = named.groupBy("seq", "name").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    distinct = written(distinct, "distinct")
    turns = distinct.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    in_order = distinct.repartitionByRange(shards, "seq").sortWithinPartitions("seq")
    place = F.monotonically_increasing_id()
    sharded = in_order.select("*", F.shiftright(place, 33).cast("int").alias("shard"), place.bitwiseAND((1 << 33) - 1).alias("place"))
    sharded = written(sharded, "shards")
    nodes = written(sharded.join(_edges(sharded), "shard").groupBy("shard").applyInArrow(_shard, _NODE), "nodes")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = written(
        nodes.where("prefix IS NOT NULL").groupBy("prefix", "parent_prefix", "depth")
        .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in figures], F.max("ends").alias("ends")), "boundary")
    columns = ["conv_id", "depth", "parent_conv_id", *figures, "ends"]
    inner = nodes.where("prefix IS NULL")
    below = inner.where("parent_prefix IS NOT NULL").drop("prefix", "parent_conv_id").unionByName(merged.where("parent_prefix IS NOT NULL").drop("prefix"))
    # The children of a boundary node look their parent up, as many as it has children.
    parents = merged.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("asked"))
    found = join_unique(below, parents, ["parent_prefix"], "asked").select(*columns)
    top = merged.where("parent_prefix IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    whole = written(inner.where("parent_prefix IS NULL").select(*columns).unionByName(found).unionByName(top.select(*columns)), "trie")
    ended = whole.where("ends IS NOT NULL").join(ends_digests(named.select("name", "conv_id")), F.col("ends") == F.col("name"))
    return (
        ended.select(*columns[:-1], "ends_sha256")
        .unionByName(whole.where("ends IS NULL").select(*columns[:-1], F.lit(NO_ENDS).alias("ends_sha256")))
    )


def shared_prefixes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of conversations that take their first (crc32 of the id) mod 6 turns from the one at the hundred below."""
    conv = F.col("conv_id")
    h = (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("int")
    return trie(rebuilt(encoded(conversations), h, conv - conv % EVERY, BORROWED - 1), shard_turns)


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(t ORDER BY turn NULLS FIRST, key) AS s, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {BORROWED} AS h FROM c GROUP BY conv_id
), r AS (
  SELECT o.conv_id AS c, list_concat(list_slice(coalesce(b.s, []), 1, o.h), list_slice(o.s, o.h + 1, len(o.s))) AS s
  FROM o LEFT JOIN o AS b ON b.conv_id = o.conv_id - o.conv_id % {EVERY}
), p AS (
  SELECT c, unnest(range(len(s) + 1)) AS d, s FROM r
), n AS (
  SELECT list_slice(s, 1, d) AS p, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len(s)), '')) AS ends_sha256
  FROM p GROUP BY ALL
), k AS (
  SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, u.conv_id AS parent_conv_id, coalesce((n.n_convs - 1) * length(n.p[n.d].text), 0) AS own
  FROM n LEFT JOIN k ON k.d = n.d AND k.p = n.p LEFT JOIN n AS u ON u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1)
), a AS (
  SELECT list_slice(p, 1, up) AS p, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM m) GROUP BY ALL
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM m JOIN a USING (p, d)
"""
