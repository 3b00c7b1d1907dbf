"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

URLs that a rule decides are the labelled ones.  The trees are fitted to them (a
hash sample of at most ``fit_rows``) with features of the URL's writing: lengths,
depth, share of digits, entropy of the characters, number of parameters, and
statistics of the host's last label (its frequency among all URLs and its share
of blocked labelled URLs, shrunk towards the overall share).  All of it runs in
the JVM.

Null URLs and URLs without "://" have an empty host and path and all-zero
lengths; no rule fits them and the trees decide.  Repeated rows are judged alike.
With labels of one kind only, that kind is the verdict; without labels, allow.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.llm.common import written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FIT_ROWS = 50_000
TREES = 12
DEPTH = 4
SHRINK = 20.0
SEED = 17
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "digit_ratio", "host_digits",
    "hyphens", "entropy", "parameters", "has_fragment", "secure", "ending_length", "suffix_length", "suffix_share", "suffix_blocked",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        fits = _fits(text, host, path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    size = F.char_length(text)
    chars = F.array_distinct(F.split(text, ""))
    each = F.transform(chars, lambda c: (size - F.char_length(F.replace(text, c))) / F.char_length(c) / size)
    summed = F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.when(size > 0, summed).otherwise(0.0)


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.greatest(F.char_length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "url_length": F.char_length(url), "host_length": F.char_length(host), "path_length": F.char_length(path), "query_length": F.char_length(query),
        "depth": _count(path, "/[^/]"), "host_labels": _count(host, "[^.]+"), "digit_ratio": _count(url, "[0-9]") / size, "host_digits": _count(host, "[0-9]"),
        "hyphens": _count(host, "-"), "entropy": _entropy(url), "parameters": _count(query, "[^&]+"), "has_fragment": F.contains(url, F.lit("#")),
        "secure": F.startswith(F.lower(url), F.lit("https://")), "ending_length": F.char_length(F.regexp_extract(path, r"\.([^./]*)$", 1)),
    }


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' chance of block: one row per row of pages."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), verdict.alias("said"))
    lexical = _lexical(F.col("url"), F.col("host"), F.col("path"))
    suffix = F.regexp_extract("host", r"([^.]*)\.?$", 1)
    rows = written(parts.select(
        "page_id", "host", "path", "rule", "said", suffix.alias("suffix"), F.xxhash64("url", F.lit(SEED)).alias("draw"),
        (F.col("said") == "block").cast("double").alias("label"), *[c.cast("double").alias(n) for n, c in lexical.items()],
    ), "urls")
    per = written(rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("told"), F.sum("label").alias("blocked")), "suffixes")
    total = per.agg(F.sum("n").alias("n"), F.sum("told").alias("told"), F.sum("blocked").alias("blocked")).first()
    told, blocked = total["told"] or 0, total["blocked"] or 0.0
    out = [F.col(c) for c in ("page_id", "host", "path", "rule")]
    if not 0 < blocked < told:
        only = "block" if told and blocked else "allow"
        return rows.select(*out, F.coalesce("said", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("p_block"))
    overall = blocked / told
    stats = per.select(
        "suffix", F.char_length("suffix").cast("double").alias("suffix_length"), (F.col("n") / total["n"]).alias("suffix_share"),
        ((F.coalesce("blocked", F.lit(0.0)) + SHRINK * overall) / (F.col("told") + SHRINK)).alias("suffix_blocked"),
    )
    features = rows.join(stats, "suffix")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    sample = features.where(F.col("label").isNotNull())
    if told > fit_rows:
        sample = sample.where(F.pmod("draw", F.lit(1_000_000)) < int(1_000_000 * fit_rows / told))
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, checkpointInterval=-1)
    model = trees.fit(assembler.transform(written(sample.select("label", *FEATURES), "labelled")))
    scored = model.transform(assembler.transform(features))
    chance = vector_to_array("probability")[1]
    return scored.select(*out, F.coalesce("said", F.when(F.col("prediction") == 1, "block").otherwise("allow")).alias("verdict"), chance.alias("p_block"))
