"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Every rule looks at figures of one text and says good, bad or nothing.  How
often each rule is right is not set by hand: a two-class model with one pair of
accuracies per rule (how often it says good of good texts, bad of bad ones) is
fitted by expectation-maximisation to the counts of vote patterns over all
documents.  There are at most 3 ** len(RULES) patterns, whatever the corpus size, so
only their counts reach the driver.

Null text: no words.  Empty tables give empty results and a model of the priors.
Repeated rows are judged alike; extra columns stay untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loci.llm.common import fresh, texts_of, written

FIGURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_digits", "n_shouts", "n_stops", "n_common",
)
FIGURE_TYPE = StructType([StructField(c, LongType(), False) for c in FIGURES])

MIN_WORDS = 50
REPEAT_PERCENT = 50

# Function words of several languages; a running text has some of them.
COMMON = frozenset(
    "the of and to in is that it for on with as was by this a be are from or an at not have "
    "le la les de des du et en un une que qui dans pour par sur est au pas ne il elle "
    "der die das und ist in zu den von mit sich auf für nicht ein eine dem im es auch "
    "el los las y que por con para una su se del al lo como no más".split()
)
_COMMON = frozenset(w.encode() for w in COMMON)
_PACK = 21  # three word numbers of this many bits fit in one 64-bit key


def _repeat_words(ids: np.ndarray, packed: bool) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if packed:
        keys = (ids[:-2] << (2 * _PACK)) | (ids[1:-1] << _PACK) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] * n + ids[2:]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def _byte_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of kinds of bytes per text, worked out over the whole batch at once."""
    column = column.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = (int(bounds[0]), int(bounds[-1])) if len(bounds) else (0, 0)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first:last]
    code = np.arange(256)
    blank = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    kinds = {
        "outside": ((code & 0xC0) == 0x80) | blank,
        "n_symbols": np.isin(code, list(b"#*$%&|<>")),
        "n_upper": (code >= 65) & (code <= 90),
        "others": ~(((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))),
        "n_digits": (code >= 48) & (code <= 57),
        "n_shouts": code == ord("!"),
        "n_stops": np.isin(code, list(b".?")),
    }
    out = {}
    for name, member in kinds.items():
        at = np.flatnonzero(member[data])
        out[name] = np.diff(np.searchsorted(at, bounds - first))
    out["word_chars"] = np.diff(bounds) - out.pop("outside")
    out["n_letters"] = np.diff(bounds) - out.pop("others")
    return out


def figures_of(column: pa.Array) -> pa.StructArray:
    """All figures of a batch of texts."""
    counts = _byte_counts(column)
    n = len(column)
    for name in ("n_words", "n_dup_lines", "n_repeat_words", "n_lines", "n_common"):
        counts[name] = np.zeros(n, np.int64)
    seen: dict[bytes, int] = {}
    for i, text in enumerate(texts_of(column)):
        if not text:
            continue
        words = text.split()
        counts["n_words"][i] = len(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        counts["n_lines"][i] = len(lines)
        counts["n_dup_lines"][i] = len(lines) - len(set(lines))
        counts["n_common"][i] = sum(map(_COMMON.__contains__, words))
        if len(seen) + len(words) > 1 << _PACK:
            seen = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        counts["n_repeat_words"][i] = _repeat_words(ids, len(words) <= 1 << _PACK)
    return pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in FIGURES], list(FIGURES))


def figures(text: Column) -> Column:
    """Figures of a text as one struct, by an Arrow function."""

    @F.arrow_udf(returnType=FIGURE_TYPE)
    def measured(column: pa.Array) -> pa.Array:
        return figures_of(column)

    return measured(text)


def rules(f: Column) -> dict[str, tuple[Column, Column]]:
    """For each rule, when it says good and when it says bad; else it abstains."""
    words = F.greatest(f["n_words"], F.lit(1))
    letters = F.greatest(f["n_letters"], F.lit(1))
    share = f["n_repeat_words"] / words
    mean = f["word_chars"] / words
    return {
        "symbols": (F.lit(False), f["n_symbols"] > 0.3 * words),
        "capitals": (F.lit(False), f["n_upper"] > 0.5 * letters),
        "shouting": (F.lit(False), f["n_shouts"] > 0.2 * words),
        "lines": (F.lit(False), f["n_dup_lines"] * 2 > F.greatest(f["n_lines"], F.lit(1))),
        "repetition": (share < 0.1, share > 0.4),
        "word_length": ((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14)),
        "function_words": (f["n_common"] >= 0.05 * words, (f["n_common"] == 0) & (f["n_words"] >= 30)),
        "sentences": ((f["n_stops"] * 100 > words) & (f["n_stops"] * 3 < words), F.lit(False)),
    }


RULES = ("symbols", "capitals", "shouting", "lines", "repetition", "word_length", "function_words", "sentences")


def votes(f: Column) -> list[Column]:
    """One column per rule: 1 good, -1 bad, 0 abstains."""
    said = rules(f)
    return [F.when(said[r][1], -1).when(said[r][0], 1).otherwise(0).alias(f"vote_{r}") for r in RULES]


SAYS = (-1, 0, 1)


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and per rule the chances of saying bad, nothing and good of either class."""

    good: float
    of_good: tuple[tuple[float, float, float], ...]
    of_bad: tuple[tuple[float, float, float], ...]

    def accuracies(self) -> list[tuple[float, float]]:
        """Per rule: how often it is right about good and about bad texts where it speaks."""
        return [(g[2] / (g[0] + g[2]), b[0] / (b[0] + b[2])) for g, b in zip(self.of_good, self.of_bad, strict=True)]

    def log_odds(self, spoken: list[Column]) -> Column:
        total = F.lit(math.log(self.good) - math.log1p(-self.good))
        for vote, g, b in zip(spoken, self.of_good, self.of_bad, strict=True):
            bad, none, good = (math.log(x) - math.log(y) for x, y in zip(g, b, strict=True))
            total = total + F.when(vote == 1, good).when(vote == -1, bad).otherwise(none)
        return total

    def posterior(self, spoken: list[Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(spoken)))


def fit_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 5.0) -> LabelModel:
    """Expectation-maximisation over vote patterns and how often each occurs.

    It starts from the belief that a text some rule calls bad is bad.  A
    Dirichlet prior of ``prior`` votes per rule and class says that rules are
    right more often than not, which keeps the classes from changing places.
    """
    says = np.stack([patterns == v for v in SAYS], axis=2).astype(np.float64)
    lean_good, lean_bad = prior * np.array([0.02, 0.49, 0.49]), prior * np.array([0.3, 0.6, 0.1])
    share = np.where((patterns == -1).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        p, q = counts * share, counts * (1 - share)
        good = (p.sum() + 0.8 * prior) / (counts.sum() + prior)
        of_good = np.einsum("i,irv->rv", p, says) + lean_good
        of_bad = np.einsum("i,irv->rv", q, says) + lean_bad
        of_good /= of_good.sum(axis=1, keepdims=True)
        of_bad /= of_bad.sum(axis=1, keepdims=True)
        odds = math.log(good / (1 - good)) + np.einsum("irv,rv->i", says, np.log(of_good) - np.log(of_bad))
        before, share = share, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if not len(share) or np.abs(share - before).max() < 1e-9:
            break
    return LabelModel(float(good), tuple(map(tuple, of_good.tolist())), tuple(map(tuple, of_bad.tolist())))


def fit(measured: DataFrame, column: str) -> LabelModel:
    """Fit to all rows of a table with a figures column."""
    names = [f"vote_{r}" for r in RULES]
    rows = measured.select(*votes(F.col(column))).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    patterns = np.array([[x[c] for c in names] for x in rows], np.int64).reshape(len(rows), len(names))
    return fit_counts(patterns, np.array([x["n"] for x in rows], np.float64))


def base_failed(f: Column, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> Column:
    return (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > repeat_percent * f["n_words"])


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the figures, base_failed, each rule's vote, the posterior and whether to keep the document."""
    measured = written(docs.select("doc_id", figures(F.col("text")).alias("f")), "figures")
    f = F.col("f")
    posterior = fit(measured, "f").posterior(votes(f))
    return measured.select(
        "doc_id", *[f[c].alias(c) for c in FIGURES], *votes(f), base_failed(f).alias("base_failed"), posterior.alias("p_good"),
        (~base_failed(f) & (posterior >= threshold)).alias("kept"),
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns.

    Figures are worked out twice, once to fit and once to filter, which costs
    less than a shuffle of all texts.
    """
    (name,) = fresh(docs, "figures")
    model = fit(docs.select(figures(F.col("text")).alias("f")), "f")
    f = F.col(name)
    passes = ~base_failed(f) & (model.posterior(votes(f)) >= threshold)
    return docs.withColumn(name, figures(F.col("text"))).where(passes).select(*docs.columns)
