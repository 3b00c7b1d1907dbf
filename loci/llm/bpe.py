"""Byte-level BPE encoding and decoding, with a contiguous rank array for each short word.

A text is cut at the vocabulary's added tokens, then at spaces into chunks that cannot
share a token, and each distinct chunk is encoded once per task.  A chunk is cut into
words by the vocabulary's pattern.  A word holds its parts and, beside them in a contiguous
array, the rank of each part's merge with the next one.  The array is scanned for the
least rank, the boundary behind it goes, and the two ranks next to it are looked up
again, until nothing can merge.  New words of one length do this side by side, a row
each.  A scan costs the word's length, so words over ``SHORT`` bytes keep the same
values in a heap with links instead and merge in the same order.

Letters, numbers and white space are those of the ``regex`` module; code points that
Python's own tables do not know yet are classed as the tokenizer's library classes them.

Decoding looks up each id's bytes and reads them all as UTF-8; broken sequences become
U+FFFD.  Ids the vocabulary does not have are left out.

Null and empty texts have no ids and decode to an empty text.  Very long texts and words
are encoded whole; what is remembered is bounded in number and bytes.  Each row is encoded by itself, so
repeated rows agree; an empty table gives an empty result.  Other columns stay, and the
new ones take names with leading underscores where theirs clash.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import types
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.llm.common import fresh, numbered, texts_of

SHORT = 128
REMEMBERED, REMEMBERED_BYTES = 600_000, 48 << 20
TOGETHER_BYTES = 4 << 20  # text encoded at a time
CELLS = 1 << 20  # parts merged at a time
# Fixed value: the public pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = np.iinfo(np.int32).max
# White space in UTF-8, by length.
_SPACES = (rb"[\t-\r ]", rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_RUN = re.compile(rb"(?:" + rb"|".join(_SPACES) + rb") ")
_CUT = re.compile(rb"".join(rb"(?<!" + alt + rb")" for s in _SPACES for alt in s.split(b"|")) + rb" ")
_ENDS_OPEN = re.compile(rb"(?:" + rb"|".join(_SPACES) + rb")\Z")
_FIRST, _ADDED = b"\xff", b"\xfe"  # mark chunks without a space before them, and added tokens; neither occurs in UTF-8


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a vocabulary: itself if printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Lists:
    """Rows of ids one after another in one array, found by number."""

    def __init__(self):
        self.starts, self.sizes, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.flat, self.used = np.zeros(8192, np.int32), 0

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> int:
        """Add rows of these sizes; the number of the first."""
        first = self.count
        for name, need in (("starts", first + len(sizes)), ("sizes", first + len(sizes)), ("flat", self.used + len(ids))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        self.sizes[first : first + len(sizes)] = sizes
        self.starts[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.count, self.used = first + len(sizes), self.used + len(ids)
        return first

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of some rows, and their ids in a row."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return sizes, self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Bpe:
    """A byte-level BPE vocabulary (a tokenizers file) and the chunks and words encoded with it so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, added = held["model"], held.get("added_tokens") or []
        letters = byte_letters()
        names = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(names[a], names[b]): i for i, (a, b) in enumerate(pairs)}
        self.merged = np.array([names[a + b] for a, b in pairs], np.int32)
        self.byte_id = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_id[byte] = names[letter]
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], -1), np.append(order, 0).astype(np.int32)
        self.byte_ranks = self._ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.bytes_of = {i: bytes(letters[c] for c in name) for name, i in names.items()}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added) or held.get("normalizer"):
            raise ValueError("added tokens that take white space, and normalizers, are not supported")
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.bytes_of |= {i: name for name, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_at = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if longest_first else None
        self.pattern = regex.compile(PATTERN)
        self.newer: dict[str, str] = {}
        self.clear()

    def clear(self) -> None:
        self.chunk_at: dict[bytes, int] = {}
        self.word_at: dict[bytes, int] = {}
        self.chunks, self.words, self.held = Lists(), Lists(), 0

    # words

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _NEVER where they do not merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys[:-1], wanted)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], _NEVER)

    def _scan(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, each with its own rank array; rows of the arrays are words.

        Every round takes one boundary out of every word that still merges, so the rows keep one length.
        """
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        ids, ranks, names = self.byte_id[raw], self.byte_ranks[raw[:, :-1], raw[:, 1:]], np.arange(len(words))
        done = []
        while True:
            rows = np.arange(len(ids))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            best = ranks[rows, at] if ranks.shape[1] else np.full(len(ids), _NEVER)
            still = best < _NEVER
            if not still.all():
                done.append((names[~still], ids[~still]))
                ids, ranks, names, at, best = ids[still], ranks[still], names[still], at[still], best[still]
                rows = np.arange(len(ids))
            if not len(ids):
                break
            ids[rows, at] = self.merged[best]
            keep_id, keep_rank = np.ones(ids.shape, bool), np.ones(ranks.shape, bool)
            keep_id[rows, at + 1] = keep_rank[rows, at] = False
            width = ids.shape[1] - 1
            ids, ranks = ids[keep_id].reshape(len(ids), width), ranks[keep_rank].reshape(len(ids), width - 1)
            for side in (at, at - 1):  # the pairs that the new part is left and right of
                some = np.flatnonzero((side >= 0) & (side < width - 1))
                ranks[some, side[some]] = self._ranks(ids[some, side[some]], ids[some, side[some] + 1])
        sizes = np.zeros(len(words), np.int64)
        for who, found in done:
            sizes[who] = found.shape[1]
        starts, flat = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.int32)
        for who, found in done:
            flat[starts[who][:, None] + np.arange(found.shape[1])] = found
        return sizes, flat

    def _heap(self, word: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        rank = self.rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], gone[j], after[i] = int(self.merged[best]), 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, dropped in zip(ids, gone, strict=True) if not dropped]

    def _learn_words(self, words: list[bytes]) -> None:
        """Merge new words, those of one length together."""
        by_length: dict[int, list[bytes]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for length, some in by_length.items():
            step = max(1, CELLS // length) if length <= SHORT else 1
            for k in range(0, len(some), step):
                part = some[k : k + step]
                if length <= SHORT:
                    first = self.words.add(*self._scan(part))
                else:
                    ids = self._heap(part[0])
                    first = self.words.add(np.array([len(ids)]), np.array(ids, np.int32))
                self.word_at.update(zip(part, range(first, first + len(part))))
                self.held += length * len(part)

    # chunks

    def _class_letter(self, c: str) -> str:
        """A letter, digit or sign of the class the library gives a code point that is newer than Python's tables."""
        if c not in self.newer:
            from tokenizers.pre_tokenizers import ByteLevel

            cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
            self.newer[c] = "a" if len(cut("a" + c)) == 1 else "1" if len(cut("1" + c)) == 1 else "*"
        return self.newer[c]

    def _words_of(self, chunk: bytes) -> list[bytes]:
        text = chunk.decode()
        if text.isascii():
            return [w.encode() for w in self.pattern.findall(text)]
        newer = {ord(c): self._class_letter(c) for c in set(text) if unicodedata.category(c) == "Cn"}
        if not newer:
            return [w.encode() for w in self.pattern.findall(text)]
        return [text[m.start() : m.end()].encode() for m in self.pattern.finditer(text.translate(newer))]

    def _learn_chunks(self, keys: list[bytes]) -> None:
        """Encode new chunks.  Those that begin with a space and end in none are cut together."""
        added = [k for k in keys if k[:1] == _ADDED]
        alone = [k for k in keys if k[:1] == _FIRST or not k or (k[:1] != _ADDED and _ENDS_OPEN.search(k))]
        apart = {*added, *alone}
        usual = [k for k in keys if k not in apart]
        words = self._words_of(b"".join(b" " + k for k in usual))
        ends = np.cumsum(np.fromiter((len(k) + 1 for k in usual), np.int64, len(usual)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.bincount(np.searchsorted(ends, np.cumsum(lengths) - lengths, side="right"), minlength=len(usual)).tolist()
        for key in alone:
            found = self._words_of(key[1:] if key[:1] == _FIRST else b" " + key)
            words += found
            counts.append(len(found))
        new = {w for w in words if w not in self.word_at}
        if new:
            self._learn_words(sorted(new))
        sizes, ids = self.words.joined(np.fromiter(map(self.word_at.__getitem__, words), np.int64, len(words)))
        before = np.append(0, np.cumsum(sizes))
        cuts = np.append(0, np.cumsum(counts)).astype(np.int64)
        ordered = [*usual, *alone, *added]
        all_sizes = np.append(np.diff(before[cuts]), np.ones(len(added), np.int64))
        first = self.chunks.add(all_sizes, np.append(ids, np.array([self.added[k[1:]] for k in added], np.int32)))
        self.chunk_at.update(zip(ordered, range(first, first + len(ordered)), strict=True))
        self.held += sum(map(len, ordered))

    def _keys(self, text: bytes) -> list[bytes]:
        """Chunks of a text: cut at added tokens and at spaces that no white space precedes; the space is left off."""
        if _FIRST in text or _ADDED in text:
            text = text.decode("utf-8", "replace").encode()
        out = []
        for i, piece in enumerate(self.added_at.split(text) if self.added_at else [text]):
            if i % 2:
                out.append(_ADDED + piece)
            elif piece:
                parts = _CUT.split(piece) if _RUN.search(piece) else piece.split(b" ")
                parts[0] = _FIRST + parts[0]
                out += parts
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of texts."""
        out, group, size = [], [], 0
        for i, text in enumerate(texts):
            group.append(self._keys(text or b""))
            size += len(text or b"")
            if size > TOGETHER_BYTES or i + 1 == len(texts):
                out += self._encode(group)
                group, size = [], 0
        return out

    def _encode(self, group: list[list[bytes]]) -> list[np.ndarray]:
        if self.chunks.count + self.words.count > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.clear()
        found = numbered(group, self.chunk_at, self._learn_chunks)
        return [self.chunks.joined(at)[1] for at in found]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        if isinstance(ids, np.ndarray):
            ids = ids.tolist()
        return b"".join(map(self.bytes_of.get, ids, repeat(b""))).decode("utf-8", "replace")


def shared_bpe(path: str) -> Bpe:
    """The Bpe of this process: a worker that runs several tasks keeps what it has learnt."""
    held = sys.modules.setdefault("_loci_llm_process", types.ModuleType("_loci_llm_process")).__dict__.setdefault("bpe", {})
    key = os.path.realpath(path)
    if key not in held:
        held[key] = Bpe(path)
    return held[key]


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))


def encode(text: Column, path: str) -> Column:
    """Ids (array of int) of a text column.  ``path`` is a tokenizers file that every executor can read."""

    @F.arrow_udf(returnType="array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = shared_bpe(path)
        for column in batches:
            yield _lists(bpe.encode(texts_of(column)))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Texts of a column of ids; null for null."""

    @F.arrow_udf(returnType="string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = shared_bpe(path)
        for column in batches:
            yield pa.array([None if i is None else bpe.decode(i) for i in column.to_pylist()], pa.string())

    return texts(ids)


def coded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """A table with the ids of a text column and the text they decode to, both worked out in one pass.

    The new columns come last, under the names given (with underscores before them where a column of that name is there).
    """
    ids, decoded, both = fresh(docs, ids, decoded, "both")

    @F.arrow_udf(returnType="ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = shared_bpe(path)
        for column in batches:
            found = bpe.encode(texts_of(column))
            yield pa.StructArray.from_arrays([_lists(found), pa.array([bpe.decode(i) for i in found], pa.string())], ["ids", "decoded"])

    both_of = run(F.col(text)).alias(both)
    return docs.select("*", both_of).select(*docs.columns, F.col(both)["ids"].alias(ids), F.col(both)["decoded"].alias(decoded))


def digested(table: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, number of ids, and digests of the ids in decimal and of the decoded text."""
    decimal = F.array_join(F.col(ids).cast("array<string>"), ",")
    return table.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
