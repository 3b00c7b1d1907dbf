"""Cutting texts: drawer-sized chunks, exchanges, line groups."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loci.functions import fixed
from loci.functions import text as tx
from loci.functions.text import WHITESPACE

_CHUNKS = "array<struct<content:string,chunk_index:int>>"


def _last(places: list[int], low: float, high: int) -> int | None:
    """The largest place above ``low`` and not above ``high``."""
    k = bisect_right(places, high) - 1
    return places[k] if k >= 0 and places[k] > low else None


def _spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Beginning and end of each window: the end is a blank line, else a line end, of its second half, else its full size.

    The places of all breaks are found once; every end is looked up among them.
    """
    line_ends = [m.start() for m in re.finditer("\n", text)]
    blank_lines = [p for p, q in zip(line_ends, line_ends[1:]) if q == p + 1]
    begin = 0
    while begin + size < len(text):
        middle, full = begin + size / 2, begin + size
        end = _last(blank_lines, middle, full) or _last(line_ends, middle, full) or full
        yield begin, end
        begin = end - overlap
    if begin < len(text):
        yield begin, len(text)


def _cut(text: str, size: int, overlap: int, least: int) -> list[tuple[str, int]]:
    """Windows of a text that have something in them, numbered."""
    body = text.strip(WHITESPACE)
    pieces = (body[a:b].strip(WHITESPACE) for a, b in _spans(body, size, overlap))
    return [(piece, k) for k, piece in enumerate(p for p in pieces if len(p) >= least)]


def chunks(
    content: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, least: int = fixed.CHUNK_MIN,
) -> Column:
    """array<struct<content, chunk_index>> of a text.

    Each chunk starts where the one before ended, minus the overlap, so this
    is a per-row Arrow function: no built-in can carry that position.
    """

    @pandas_udf(_CHUNKS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _cut(t, size, overlap, least))

    return cut(content)


def chunk_text(docs: DataFrame, text: str = "document", **kw) -> DataFrame:
    """One row per chunk, with the document's other columns."""
    rest = [c for c in docs.columns if c != text]
    exploded = docs.withColumn("_chunk", F.explode(chunks(F.col(text), **kw)))
    return exploded.select(*rest, F.col("_chunk.content").alias("content"), F.col("_chunk.chunk_index").alias("chunk_index"))


def _numbered(contents: Column) -> Column:
    return F.transform(contents, lambda c, i: F.struct(c.alias("content"), i.alias("chunk_index")))


def exchanges(content: Column, least: int = fixed.EXCHANGE_MIN, answer_lines: int | None = None) -> Column:
    """array<struct<content, chunk_index>>: a quoted user line with its answer.

    With fewer than three `>` lines, paragraphs; and a single block of more
    than twenty lines falls into groups of 25.  An answer keeps all its lines,
    or the first ``answer_lines`` (fixed.EXCHANGE_ANSWER_LINES is the short form).
    """
    lines = tx.lines_of(content)
    quoted = F.size(F.filter(lines, lambda x: tx.strip(x).startswith(">")))

    # Each piece begins at a quoted line (the text before the first is dropped)
    # and ends before a rule of dashes.
    pieces = F.filter(F.split(content, r"\n(?=[^\S\n]*>)", -1), lambda p: tx.strip(p).startswith(">"))

    def exchange(piece: Column) -> Column:
        body = F.get(F.split(piece, r"\n(?=[^\S\n]*---)", 2), F.lit(0))
        kept = F.filter(F.transform(F.split(body, "\n", -1), tx.strip), lambda x: x != "")
        told = F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0)) if answer_lines is None else F.lit(answer_lines))
        answer = F.array_join(told, " ")
        asked = F.get(kept, F.lit(0))
        return F.when(answer != "", F.concat(asked, F.lit("\n"), answer)).otherwise(asked)

    by_exchange = F.transform(pieces, exchange)
    paras = tx.paragraphs(content)
    one_block = (F.size(paras) <= 1) & (F.size(lines) > fixed.LINE_GROUP_THRESHOLD)
    by_block = F.when(one_block, tx.line_groups(lines, fixed.LINE_GROUP)).otherwise(paras)
    parts = F.when(quoted >= 3, by_exchange).otherwise(by_block)
    return _numbered(F.filter(parts, lambda p: F.length(tx.strip(p)) > least))


def chunk_exchanges(docs: DataFrame, text: str = "document", answer_lines: int | None = None) -> DataFrame:
    rest = [c for c in docs.columns if c != text]
    exploded = docs.withColumn("_chunk", F.explode(exchanges(F.col(text), answer_lines=answer_lines)))
    return exploded.select(*rest, F.col("_chunk.content").alias("content"), F.col("_chunk.chunk_index").alias("chunk_index"))
