"""Entities and relations of segments, worked out batch by batch on Arrow columns.

A row's words come as lists.  What a word says by itself is worked out once per different
word; positions, merging, ranking and pairing are numpy arithmetic over all rows of a batch.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loci.functions import fixed
from loci.functions.text import WHITESPACE
from loci.functions.vectors import SCORE_DIGITS, _Codes, unit_rows
from loci.operators.registry import Table

# Rows worked on at a time.
ROWS = 4096
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_ORG = re.compile(" (?:" + "|".join(fixed.ORG_SUFFIXES) + ")(?:\\r\\n|[\\n\\r\\x85\\u2028\\u2029])?\\Z")
_PROJECT = re.compile(fixed.PROJECT_WORDS)
_CAPITAL = re.compile(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?![A-Za-z0-9_])")
_TOOLS, _ORGS, _HINTS = frozenset(fixed.TOOL_HINTS), frozenset(fixed.ORG_SUFFIXES), frozenset(fixed.PERSON_HINTS)


def infer_type(name: str | None, known: str | None) -> str:
    """``relations.infer_type`` of one name."""
    if known is not None and known != "unknown":
        return known
    if name is None:
        return "concept"
    low = name.lower()
    if low in _TOOLS:
        return "tool"
    if low in _ORGS or _ORG.search(low):
        return "org"
    if _PROJECT.search(low):
        return "project"
    return "person" if _CAPITAL.search(name) and len(_BLANKS.split(name)) <= 3 else "concept"


def title_case(name: str | None) -> str | None:
    return name if name is None else " ".join(w[0].upper() + w[1:] for w in _BLANKS.split(name) if w)


class _Words(dict):
    """(id, name, type, confidence, source) by (is it quoted, word, hits for a person, for a concept); emptied when it gets large."""

    def __init__(self, known: Table):
        super().__init__()
        self.known = known

    def __missing__(self, key):
        if len(self) > 200_000:
            self.clear()
        quoted, word, *hits = key
        kind, sure, name = self.known.find(word, *hits)
        unknown = kind == "unknown"
        if quoted:
            sure = max(sure or 0.45, 0.55)
        else:
            sure = 0.35 if unknown else sure or 0.8
            if unicodedata.category(word[0]) == "Lu" or word.lower() in _TOOLS:
                sure = max(sure, fixed.ENTITY_CONFIDENCE)
        if sure < fixed.ENTITY_CONFIDENCE:
            made = None
        else:
            low, kind = None if name is None else name.lower(), infer_type(name, kind)
            source = ("quoted" if quoted else "candidate") if unknown else "registry"
            made = (low, title_case(name) if not quoted and kind == "person" else name, kind, sure, source)
        self[key] = made
        return made


def _flat(lists: pa.ListArray):
    """Row of every word, number of words by row, the different words, and which of them each word is."""
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), lengths), lengths, coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


_QUOTED = re.compile(fixed.QUOTED_PATTERN)


def phrases(text: str) -> list[str]:
    """``relations.quoted_phrases`` of a text."""
    return list(dict.fromkeys(q for q in (m[1:-1].strip(WHITESPACE) for m in _QUOTED.findall(text)) if q))


def _phrases(texts: pa.StringArray) -> pa.ListArray:
    found = [[] if t is None else phrases(t) for t in texts.to_pylist()] if texts.null_count < len(texts) else [[]] * len(texts)
    return pa.array(found, pa.list_(pa.string()))


# What stands between pieces of text: no word of ``relations.candidate_tokens`` reaches over it.
BETWEEN = r"[^\p{L}\p{N}_-]+"
# Put in its place, which no piece contains.
MARK = "\x01"
_PLAIN = re.compile(r"[A-Za-z][A-Za-z0-9_]{1,63}")
_ASCII_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def piece_words(piece: str) -> list[str]:
    """``relations.candidate_tokens`` of a piece of text, repeats included: a letter and 1 to 63 more characters, between ASCII word boundaries."""
    if _PLAIN.fullmatch(piece):
        return [piece]
    inside = [False, *(c in _ASCII_WORD for c in piece), False]
    edge = [a != b for a, b in zip(inside, inside[1:])]
    found, at = [], 0
    while at < len(piece):
        if edge[at] and piece[at].isalpha():
            end = next((e for e in range(min(at + 64, len(piece)), at + 1, -1) if edge[e]), None)
            if end:
                found.append(piece[at:end])
                at = end
                continue
        at += 1
    return found


def spoken(text: str) -> list[str]:
    """``vectors.embedding_tokens`` of a text."""
    low = text.lower()
    if low.isalnum() and low.isascii():
        return [low]
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in low).split(" ")


class _Pieces:
    """Lists made of pieces of text, kept by piece; all is forgotten when it gets large."""

    def __init__(self, of):
        self.of, self.seen = of, {}

    def numbered(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """(number of values by piece, which value each is, the different values)."""
        if len(self.seen) > 200_000:
            self.seen.clear()
        numbers: dict = {}
        flat, counts = [], []
        for p in pieces:
            got = self.seen.get(p)
            if got is None:
                got = self.seen[p] = self.of(p)
            counts.append(len(got))
            flat += [numbers.setdefault(w, len(numbers)) for w in got]
        return np.array(counts, np.int64), np.array(flat, np.int64), list(numbers)


def _spread(row: np.ndarray, at: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of all pieces ``at`` of rows, from the values of each different piece."""
    n = counts[at] if len(at) else np.zeros(0, np.int64)
    place = np.repeat(_starts(counts)[at] if len(at) else n, n) + np.arange(n.sum()) - np.repeat(_starts(n), n)
    return np.repeat(row, n), flat[place] if len(place) else place


class _Linked:
    """Entities of a batch in order of row and place: ``row``, ``ord``, ``at`` (the place in ``made``) and ``last``, where the name comes last."""

    def __init__(self, quotable: pa.StringArray, pieces: pa.ListArray, hits: pa.StringArray, found: _Words, words: _Pieces):
        qrow, qn, qs, qat = _flat(_phrases(quotable))
        row, _, different, at = _flat(pieces)
        counts, flat, ws = words.numbered(different)
        wrow, wat = _spread(row, at, counts, flat)
        # Each word of a row once, where it comes first.
        once = np.sort(np.unique(wrow * max(len(ws), 1) + wat, return_index=True)[1])
        wrow, wat = wrow[once], wat[once]
        made = [found[True, w, 0, 0] for w in qs] + [found[False, w, 0, 0] for w in ws]
        # Words that hint at nobody are not listed, so they take no place.
        listed = np.fromiter((w.lower() not in _HINTS for w in ws), bool, len(ws))[wat] if len(wat) else np.zeros(0, bool)
        wrow, wat = wrow[listed], wat[listed]
        wn = np.bincount(wrow, minlength=len(qn))
        row, at = np.concatenate([qrow, wrow]), np.concatenate([qat, wat + len(qs)])
        place = np.concatenate([np.arange(len(qat)) - _starts(qn)[qrow], np.arange(len(wat)) - _starts(wn)[wrow] + qn[wrow]])
        if hits.null_count < len(hits):
            self._decide(row, at, qs, ws, hits, made, found)
        keep = np.fromiter((m is not None for m in made), bool, len(made))[at] if len(at) else np.zeros(0, bool)
        row, at, place = row[keep], at[keep], place[keep]
        ids: dict = {}
        number = np.fromiter((-1 if m is None else ids.setdefault(m[0], len(ids)) for m in made), np.int64, len(made))
        key = row * max(len(ids), 1) + number[at] if len(at) else row
        # By row and id; a later form of a name replaces the earlier one but keeps its place.
        order = np.lexsort((place, key))
        row, at, place, key = row[order], at[order], place[order], key[order]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        last = np.r_[first[1:], True] if len(key) else first
        row, place, at, end = row[first], place[first], at[last], place[last]
        order = np.lexsort((place, row))
        self.row, self.ord, self.at, self.last = row[order], place[order], at[order], end[order]
        self.made, self.rows = made, len(quotable)

    @staticmethod
    def _decide(row, at, qs, ws, hits, made, found):
        """Give words that the context decides an entity of their own in each row."""
        told = {(r, h["word"]): (h["person_hits"], h["concept_hits"]) for r, text in enumerate(hits.to_pylist()) if text for h in json.loads(text)}
        asked = {w for _, w in told}
        may = np.fromiter((w in asked for w in [*qs, *ws]), bool, len(qs) + len(ws))
        for i in np.flatnonzero(may[at]).tolist():
            quoted = at[i] < len(qs)
            word = qs[at[i]] if quoted else ws[at[i] - len(qs)]
            if (row[i], word) in told:
                made.append(found[bool(quoted), word, *told[row[i], word]])
                at[i] = len(made) - 1

    def column(self, field: int, kind) -> pa.Array:
        return pa.array([None if m is None else m[field] for m in self.made], kind).take(pa.array(self.at))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A few rows at a time: what is handed on, then their quotable texts, pieces, hits and words that are given."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            rows = batch.slice(at, ROWS)
            *others, quotable, pieces, hits, tokens = rows.columns
            yield others, quotable, pc.split_pattern(pieces, MARK), hits, tokens


_ENTITY = "ord int, name string, type string, confidence double, source string, _id string, _last int"


def entities(rows: DataFrame, known: Table) -> DataFrame:
    """Entities of each row by itself: its columns, but for the four last (see ``relations._with_pieces``), and ord, name, type, confidence, source, _id, _last."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([*rows.schema.fields[:-4], *T.StructType.fromDDL(_ENTITY).fields])
    names = schema.names

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, words = _Words(shared.value), _Pieces(piece_words)
        for others, quotable, pieces, hits, _ in _cut(batches):
            x = _Linked(quotable, pieces, hits, found, words)
            if len(x.row):
                row = pa.array(x.row)
                named = (x.column(f, kind) for f, kind in ((1, pa.string()), (2, pa.string()), (3, pa.float64()), (4, pa.string()), (0, pa.string())))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in others), pa.array(x.ord, pa.int32()), *named, pa.array(x.last, pa.int32())], names)

    return rows.mapInArrow(link, schema)


# --- relations ------------------------------------------------------------------------------


def _fits(types: list[str]) -> np.ndarray:
    """``relations.type_score`` of every predicate, subject type and object type."""
    out = np.empty((len(fixed.PREDICATES), len(types), len(types)))
    for n, p in enumerate(fixed.PREDICATES):
        for i, s in enumerate(types):
            for j, o in enumerate(types):
                fits = s in (*p["subjects"], "unknown") and o in (*p["objects"], "unknown")
                out[n, i, j] = 1.0 if fits else 0.82 if "unknown" in (s, o) else 0.35
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal neighbours."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))


def _best_pairs(x: _Linked, scorer, most: int | None):
    """Rows with a relation that is sure enough, and its subject, object, predicate and figures."""
    row, place, at = x.row, x.ord, x.at
    if most is not None:
        keep = _runs(row) < most
        row, place, at = row[keep], place[keep], at[keep]
    types: dict = {}
    kind = np.fromiter((0 if m is None else types.setdefault(m[2], len(types)) for m in x.made), np.int64, len(x.made))
    sure = np.fromiter((0.0 if m is None else m[3] for m in x.made), np.float64, len(x.made))
    # The two surest entities of each type, then in order again.
    order = np.lexsort((place, -sure[at], kind[at], row))
    order = order[_runs((row * max(len(types), 1) + kind[at])[order]) < 2]
    order.sort()
    row, at = row[order], at[order]
    many = np.bincount(row, minlength=x.rows)
    keep = many[row] >= 2
    row, at = row[keep], at[keep]
    asked = np.flatnonzero(many >= 2)
    if not len(asked):
        return None
    many = many[asked]
    active, ended = scorer(asked)
    means = np.maximum(active, ended) * 0.7
    # Every ordered pair of a row's entities, by first and second.
    times = np.repeat(many, many)
    i = np.repeat(np.arange(len(at)), times)
    j = np.repeat(np.repeat(_starts(many), many), times) + np.arange(len(i)) - np.repeat(_starts(times), times)
    i, j = i[i != j], j[i != j]
    of = np.repeat(np.arange(len(asked)), many)[i]
    s, o = kind[at[i]], kind[at[j]]
    both = (sure[at[i]] + sure[at[j]]) / 2 * 0.1
    fits = _fits(list(types))
    best, which = np.full(len(i), -np.inf), np.zeros(len(i), np.int64)
    for n in range(len(fits)):
        fit = fits[n][s, o]
        score = np.where(fit >= 0.5, means[of, n] + fit * 0.2 + both, -np.inf)
        better = score > best
        best[better], which[better] = score[better], n
    top = np.maximum.reduceat(best, _starts(many * (many - 1)))
    tops = np.flatnonzero(best == top[of])
    tops = tops[_runs(of[tops]) == 0]
    tops = tops[best[tops] >= fixed.FACT_CONFIDENCE]
    if not len(tops):
        return None
    r, n = of[tops], which[tops]
    a, e = active[r, n], ended[r, n]
    return asked[r], at[i[tops]], at[j[tops]], n, best[tops], np.maximum(a, e), fits[n, s[tops], o[tops]], e > a + 0.03


_FACT = ("predicate string, subject string, subject_type string, object string, object_type string, "
         "confidence double, semantic_score double, type_score double, is_end boolean")


def _scores(row: np.ndarray, code: np.ndarray, rows: int, matrix: np.ndarray) -> np.ndarray:
    """``vectors.embedded_scores`` of texts given as (row, signed bucket of a word), without spreading vectors out."""
    size = matrix.shape[1]
    key, back = np.unique(row * size + np.abs(code) - 1, return_inverse=True)
    count = np.bincount(back, np.sign(code), len(key)) if len(key) else np.zeros(0)
    of, bucket = key // size, key % size

    def length(values):
        total = np.sqrt(np.bincount(of, values * values, rows))[of] if len(of) else values
        return np.divide(values, total, out=np.zeros_like(values), where=total > 0)

    # Vectors are kept in single precision, and made one long again before they are compared.
    weight = length(length(count).astype(np.float32).astype(np.float64))
    out = np.zeros((rows, len(matrix)))
    if len(key):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] = np.add.reduceat(matrix.T[bucket] * weight[:, None], first, axis=0)
    return np.round(out, SCORE_DIGITS)


def best_facts(rows: DataFrame, known: Table, protos: list, most: int | None) -> DataFrame:
    """The best relation of each row's entities (see ``relations.extract_facts``), where there is one: columns as of ``entities``, then _FACT.

    ``protos`` are rows (predicate, mode, text, vector).
    """
    examples = sorted(protos, key=lambda r: (r["predicate"], r["mode"], r["text"]))
    groups = [[[k for k, r in enumerate(examples) if (r["predicate"], r["mode"]) == (p["id"], mode)] for p in fixed.PREDICATES] for mode in ("active", "ended")]
    shared = rows.sparkSession.sparkContext.broadcast((known, unit_rows([r["vector"] for r in examples])))
    schema = T.StructType([*rows.schema.fields[:-4], *T.StructType.fromDDL(_FACT).fields])
    names, predicates = schema.names, [p["id"] for p in fixed.PREDICATES]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, matrix = shared.value
        codes = _Codes(matrix.shape[1])
        found, words, said = _Words(table), _Pieces(piece_words), _Pieces(lambda p: [codes[w] for w in spoken(p) if w])

        def scores(pieces: pa.ListArray, tokens: pa.StringArray) -> np.ndarray:
            row, _, different, at = _flat(pieces)
            counts, flat, values = said.numbered(different)
            row, at = _spread(row, at, counts, flat)
            code = np.array(values, np.int64)[at]
            told = tokens.is_valid().to_numpy(zero_copy_only=False)
            if told.any():
                left = ~told[row]
                trow, _, different, at = _flat(pc.split_pattern(tokens, MARK))
                row, code = np.concatenate([row[left], trow]), np.concatenate([code[left], np.array([codes[w] for w in different], np.int64)[at]])
            return _scores(row, code, len(pieces), matrix)

        for others, quotable, pieces, hits, tokens in _cut(batches):
            x = _Linked(quotable, pieces, hits, found, words)

            def scorer(asked, pieces=pieces, tokens=tokens):
                asked = pa.array(asked)
                got = scores(pieces.take(asked), tokens.take(asked))
                return [np.stack([np.maximum(got[:, g].max(axis=1), 0.0) for g in side], axis=1) for side in groups]

            got = _best_pairs(x, scorer, most)
            if got is not None:
                row, s, o, n, *figures = got
                named = [pa.array([None if m is None else m[f] for m in x.made], pa.string()) for f in (1, 2)]
                made = [pa.array(predicates).take(pa.array(n)), *(c.take(pa.array(at)) for at in (s, o) for c in named), *(pa.array(f) for f in figures)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in others), *made], names)

    return rows.mapInArrow(best, schema)
