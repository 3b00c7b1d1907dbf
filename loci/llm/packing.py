"""Hierarchical multi-length packing of documents into training sequences.

Each task packs what it reads, a block of documents at a time, so nothing is
shuffled.  A document gives full windows of the longest context; what is left is
routed to the smallest tier it fits.  Tiers are packed from the longest down.  The gap
of a window is filled with the longest leftovers of shorter tiers that fit whole, and
at last with the beginning of one that does not.  Only the last window of a block stays
open; its pieces are carried into the next block.  At the end of a task the open
window is cut into sequences of power-of-two lengths, so no sequence is padded.

Sequences of one length are then dealt into steps of equal token counts, those with the
largest attention cost (sum of squared piece lengths) and the smallest in turn, so that
the steps of a block cost about the same.

Null and empty texts give the end id alone.  Repeated rows are documents of their
own, told apart by doc_row.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.llm.common import texts_of
from loci.llm.tokens import WordTokens, shared_tokens

TIERS = (4096, 2048, 1024, 512)
END_ID = 2
STEP_TOKENS = 8 * 4096
BLOCK_TOKENS = 2_000_000

OUT = (
    "doc_id long, doc_row long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, step_group long"
)

# A piece: index of its document, start and stop there.
Piece = tuple[int, int, int]


class Packer:
    """Packs pieces into windows; keeps what does not fill one."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.pool: list[tuple[int, int, int, int]] = []  # (length, document, start, stop), shortest first

    def _route(self, doc: int, start: int, stop: int) -> None:
        insort(self.pool, (stop - start, doc, start, stop))

    def _take(self, gap: int) -> Piece:
        """A piece of at most ``gap`` ids: the longest that fits whole, else the beginning of the shortest."""
        at = bisect_right(self.pool, gap, key=lambda p: p[0]) - 1
        if at >= 0:
            _, doc, start, stop = self.pool.pop(at)
            return doc, start, stop
        _, doc, start, stop = self.pool.pop(0)
        self._route(doc, start + gap, stop)
        return doc, start, start + gap

    def pack(self, sizes: Iterable[tuple[int, int]]) -> list[list[Piece]]:
        """Full windows for documents given as (index, length); leftovers stay in the pool."""
        longest = self.tiers[0]
        windows = []
        for doc, size in sizes:
            whole = size - size % longest
            windows += [[(doc, at, at + longest)] for at in range(0, whole, longest)]
            if whole < size:
                self._route(doc, whole, size)
        left = sum(p[0] for p in self.pool)
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.pool and self.pool[-1][0] > below and left >= tier:
                _, doc, start, stop = self.pool.pop()
                if stop - start > tier:  # a longer tier could not be filled any more
                    self._route(doc, start + tier, stop)
                    stop = start + tier
                window, gap = [(doc, start, stop)], tier - (stop - start)
                while gap:
                    piece = self._take(gap)
                    window.append(piece)
                    gap -= piece[2] - piece[1]
                left -= tier
                windows.append(window)
        return windows

    def rest(self) -> list[list[Piece]]:
        """The pool as windows of power-of-two lengths, longest first."""
        left = sum(p[0] for p in self.pool)
        windows = []
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                piece = self._take(gap)
                window.append(piece)
                gap -= piece[2] - piece[1]
            windows.append(window)
            left -= size
        return windows


def deal_steps(windows: list[list[Piece]], step_tokens: int = STEP_TOKENS) -> np.ndarray:
    """A step number for each window: one window length to a step, equal tokens, even attention cost."""
    size = np.array([sum(b - a for _, a, b in w) for w in windows], np.int64)
    cost = np.array([sum((b - a) ** 2 for _, a, b in w) for w in windows], np.int64)
    steps, first = np.zeros(len(windows), np.int64), 0
    for length in sorted(set(size.tolist()), reverse=True):
        members = np.flatnonzero(size == length)
        members = members[np.argsort(-cost[members], kind="stable")]
        groups = -(-len(members) // max(1, step_tokens // length))
        turn, at = np.divmod(np.arange(len(members)), groups)
        steps[members] = first + np.where(turn % 2 == 0, at, groups - 1 - at)
        first += groups
    return steps


def _packed(make_tokens: Callable[[], WordTokens], tiers: tuple[int, ...], end_id: int, step_tokens: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        tokens, packer = make_tokens(), Packer(tiers)
        docs: dict[int, tuple[int | None, np.ndarray]] = {}
        new: list[tuple[int, int]] = []
        count, held, sequences, steps = 0, 0, 0, 0

        def emit(windows: list[list[Piece]]) -> Iterable[pa.RecordBatch]:
            nonlocal sequences, steps
            if not windows:
                return
            dealt = deal_steps(windows, step_tokens)
            rows = []
            for i, window in enumerate(windows):
                at, size = 0, sum(b - a for _, a, b in window)
                for doc, a, b in window:
                    name, ids = docs[doc]
                    rows.append((name, base + doc, a, b - a, ids[a:b].astype("<u4").tobytes(), len(ids), base + sequences + i, at, size, base + steps + int(dealt[i])))
                    at += b - a
            sequences, steps = sequences + len(windows), steps + int(dealt.max()) + 1
            names = [x.split()[0] for x in OUT.split(", ")]
            kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
            for k in range(0, len(rows), 2048):
                columns = zip(*rows[k : k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts_of(batch.column(1))), strict=True):
                docs[count] = (name, np.append(ids, np.uint32(end_id)))
                new.append((count, len(ids) + 1))
                held += len(ids) + 1
                count += 1
            if held >= block_tokens:
                yield from emit(packer.pack(new))
                left = {p[1] for p in packer.pool}
                docs = {k: v for k, v in docs.items() if k in left}
                new, held = [], 0
        yield from emit(packer.pack(new))
        yield from emit(packer.rest())

    return run


def packed(
    docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of documents with their token ids (little-endian unsigned 32-bit), sequence and place there.

    ``tokenizer`` is the path of a tokenizers file that every executor can read.
    """
    run = _packed(lambda: shared_tokens(tokenizer), tiers, end_id, step_tokens, block_tokens)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUT)


def digested(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    first = ("doc_id", "start", "length")
    rest = [c for c in pieces.columns if c not in (*first, "ids")]
    return pieces.select(*first, F.crc32("ids").alias("ids_crc32"), *rest)
