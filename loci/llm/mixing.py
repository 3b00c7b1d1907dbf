"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Each source asks for its weight's share of all words.  Sources that would be
repeated more than ``max_epochs`` times are clamped there, and what they leave
is shared among the others by weight, until none is above.  With sources sorted
by (cap / weight) the level reached after clamping the first k is
(total - their caps) / (weights of the rest); the final level is the largest of
these, so no loop is needed.

A source with target / size = 2.4 gives every document twice and some a third
time.  Those are found first-fit: documents are put in a seeded order and each is
taken if it fits into the words still wanted.  If more is still wanted than the smallest
document left, as where one document holds most of a source, the walk starts again and others come
once more, as long as none exceeds ``max_epochs``.  At the end the smallest document that may come again is added
if that brings the sum nearer.
First-fit is done in rounds for all sources at once: documents no larger than the
gap are taken up to the first that does not fit, then the next round goes on behind it
with the smaller gap.  Running sums are taken over hash buckets of a source first and
over documents only inside the one bucket where a round ends, so a source with a third
of all rows is no large group.  Once at most ``FOLD`` documents could still fit, one
array walks through them.

Null text: size 0.  The null source is one source, last in order.  Rows with the
same doc_id and text share one decision, null doc_ids included.  Documents without words come as often as
the source's whole repetitions, once at least.  Long texts count whole.  An empty
table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loci.llm.common import WORD, written
from loci.operators.skew import join_unique

MAX_EPOCHS = 3
SEED = 17
BUCKET_DIGITS = 3  # hexadecimal digits: 4096 buckets for each source
FOLD = 2000


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, repeating."""
    return (rank - 1) % 3 + 1


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _order(seed: int) -> Column:
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}|"), text).cast("binary"))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One narrow row per document: doc_id, source, size and its place in the seeded order."""
    return docs.select(
        "doc_id", "source", words_in(F.col("text")).alias("size"), _order(seed).alias("place"),
        F.coalesce("source", F.lit("")).alias("s"), F.isnull("source").alias("none"),
    )


def fill(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weight=cyclic_weight) -> DataFrame:
    """Targets of sources from a table (s, none, source_size) with one row per source."""
    by_name = Window.orderBy("none", "s")
    ranked = sizes.withColumn("weight", weight(F.row_number().over(by_name))).withColumn("cap", max_epochs * F.col("source_size"))
    ratio = F.col("cap") / F.col("weight")
    earlier = Window.orderBy(ratio, "none", "s").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    )
    levels = ranked.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return levels.select("s", "none", "source_size", "weight", target.alias("target"))


KEY = ["s", "none"]
_AT = ["place", "size"]
_NO_PICKS = "CAST(array() AS array<struct<place: string, size: bigint>>)"
_NO_STEPS = "CAST(array() AS array<struct<most: bigint, cut: struct<place: string, size: bigint>>>)"


def _walked(left: DataFrame) -> DataFrame:
    """First-fit over the few documents left of a source: its gap afterwards, and what was taken."""
    docs = F.sort_array(F.collect_list(F.struct("place", "size", "words")))
    start = F.struct(F.col("gap"), F.expr(_NO_PICKS).alias("picks"))

    def step(held: Column, d: Column) -> Column:
        took = F.struct((held["gap"] - d["words"]).alias("gap"), F.array_append(held["picks"], F.struct(d["place"].alias("place"), d["size"].alias("size"))).alias("picks"))
        return F.when(d["words"] <= held["gap"], took).otherwise(held)

    walked = left.groupBy(*KEY, "gap").agg(docs.alias("docs")).select(*KEY, F.aggregate("docs", start, step).alias("w"))
    return walked.select(*KEY, F.col("w.gap").alias("gap"), F.col("w.picks").alias("picks"))


def _run_up(left: DataFrame) -> DataFrame:
    """All documents of each source up to the first that does not fit: gap afterwards, and (place, size) of the last."""
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    left = left.withColumn("bucket", bucket)
    pieces = written(left.groupBy(*KEY, "gap", "bucket").agg(F.sum("words").alias("words")), "pieces")
    running = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    edge = written(starts.where("before <= gap AND gap < before + words").select(*KEY, "bucket", "before"), "edge")
    inside = Window.partitionBy(*KEY).orderBy(*_AT).rowsBetween(Window.unboundedPreceding, 0)
    near = (
        left.join(edge, [*KEY, "bucket"]).withColumn("reached", F.col("before") + F.sum("words").over(inside))
        .where("reached <= gap").groupBy(*KEY).agg(F.max(F.struct(*_AT)).alias("last"), F.max("reached").alias("reached"))
    )
    everything = pieces.groupBy(*KEY, "gap").agg(F.sum("words").alias("all"))
    nothing_there = F.struct(F.col("bucket").alias("place"), F.lit(-1).cast("bigint").alias("size"))
    beyond = F.struct(F.lit("g").alias("place"), F.lit(0).cast("bigint").alias("size"))  # behind every hexadecimal place
    cut = F.when(F.isnull("bucket"), beyond).otherwise(F.coalesce("last", nothing_there))
    used = F.when(F.isnull("bucket"), F.col("all")).otherwise(F.coalesce("reached", "before"))
    return everything.join(edge, KEY, "left").join(near, KEY, "left").select(*KEY, (F.col("gap") - used).alias("gap"), cut.alias("cut"), F.col("gap").alias("most"))


def first_fit(units: DataFrame, wanted: DataFrame, fold: int = FOLD) -> DataFrame:
    """For sources (s, none, gap): the rounds (steps) and single documents (picks) that fill the gap from units (s, none, place, size, words)."""
    state = written(wanted.select(*KEY, "gap", F.expr(_NO_STEPS).alias("steps"), F.expr(_NO_PICKS).alias("picks")), "state")
    left = units.join(state.select(*KEY, "gap"), KEY).where("words > 0 AND words <= gap")
    while True:
        left = written(left, "left")
        counts = written(left.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "counts")
        if counts.isEmpty():
            break
        sized_left = left.join(counts, KEY)
        walked = _walked(sized_left.where(F.col("n") <= fold)).withColumns({"cut": F.lit(None).cast("struct<place: string, size: bigint>"), "most": F.lit(None).cast("bigint")})
        ran = written(_run_up(sized_left.where(F.col("n") > fold).drop("n")), "ran")
        news = ran.withColumn("picks", F.expr(_NO_PICKS)).unionByName(walked).select(*KEY, F.col("gap").alias("rest"), F.col("picks").alias("new"), "cut", "most")
        step = F.array(F.struct("most", "cut"))
        state = written(state.join(news, KEY, "left").select(
            *KEY, F.coalesce("rest", "gap").alias("gap"), F.when(F.isnull("cut"), F.col("steps")).otherwise(F.concat("steps", step)).alias("steps"),
            F.concat("picks", F.coalesce("new", F.expr(_NO_PICKS))).alias("picks")), "state")
        ahead = left.drop("gap").join(ran.select(*KEY, "gap", "cut"), KEY)
        left = ahead.where((F.struct(*_AT) > F.col("cut")) & (F.col("words") <= F.col("gap"))).drop("cut")
    return state


def _times(words: Column, place: Column, size: Column) -> Column:
    """How often the walks took a document."""
    here = F.struct(place.alias("place"), size.alias("size"))

    def took(fill: Column) -> Column:
        return F.exists(fill["steps"], lambda r: (words <= r["most"]) & (here <= r["cut"])) | F.array_contains(fill["picks"], here)

    return F.size(F.filter("fills", took))


def filled(units: DataFrame, targets: DataFrame, max_epochs: int, fold: int = FOLD) -> DataFrame:
    """For sources (s, none, whole, gap): the walks (fills) that fill the gap from units."""
    fills = F.expr("CAST(array() AS array<struct<steps: array<struct<most: bigint, cut: struct<place: string, size: bigint>>>, picks: array<struct<place: string, size: bigint>>>>)")
    state = targets.select(*KEY, "whole", "gap", fills.alias("fills"))
    for walk in range(1, max_epochs + 1):
        again = first_fit(units, state.where(F.col("whole") + walk <= max_epochs), fold).select(*KEY, F.col("gap").alias("rest"), F.struct("steps", "picks").alias("fill"))
        took = F.coalesce(F.size("fill.steps") + F.size("fill.picks") > 0, F.lit(False))
        state = written(state.join(again, KEY, "left").select(
            *KEY, "whole", F.coalesce("rest", "gap").alias("gap"), F.when(took, F.concat("fills", F.array("fill"))).otherwise(F.col("fills")).alias("fills"), took.alias("took")), "walks")
        if state.where("took AND gap > 0").isEmpty():
            break
    may = units.where("words > 0").join(state.where("gap > 0"), KEY).where(F.col("whole") + _times(F.col("words"), F.col("place"), F.col("size")) < max_epochs)
    least = may.groupBy(*KEY).agg(F.min(F.struct("words", *_AT)).alias("least"))
    nearer = F.col("least.words") < 2 * F.col("gap")
    pick = F.struct(F.expr(_NO_STEPS).alias("steps"), F.array(F.struct("least.place", "least.size")).alias("picks"))
    return state.join(least, KEY, "left").select(*KEY, F.when(nearer, F.concat("fills", F.array(pick))).otherwise(F.col("fills")).alias("fills"))


def plan(rows: DataFrame, max_epochs: int = MAX_EPOCHS, fold: int = FOLD) -> tuple[DataFrame, DataFrame]:
    """Per source: source_size, target, whole repetitions and what comes once more; and the documents of several rows, decided as one."""
    units = written(rows.groupBy(*KEY, *_AT).agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("words")), "units")
    targets = fill(units.groupBy(*KEY).agg(F.sum("words").alias("source_size")), max_epochs)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(share)).withColumn("gap", F.floor((share - F.floor(share)) * F.col("source_size")))
    targets = written(targets, "targets")
    mix = written(targets.drop("gap").join(filled(units, targets, max_epochs, fold), KEY, "left"), "mix")
    several = units.where("copies > 1").join(mix, KEY).select(*KEY, *_AT, "copies", _times(F.col("words"), F.col("place"), F.col("size")).alias("again"))
    return mix, written(several, "several")


def _repeated(rows: DataFrame, mix: DataFrame, several: DataFrame) -> DataFrame:
    """Rows (s, none, place, size, ...) with the figures of their source and the times each is taken."""
    joined = join_unique(rows, several, [*KEY, *_AT], "copies", "left").drop("copies").join(mix, KEY)
    again = F.coalesce("again", _times(F.col("size"), F.col("place"), F.col("size")))
    times = F.when(F.col("size") > 0, F.col("whole") + again).otherwise(F.greatest("whole", F.lit(1)))
    return joined.withColumn("times", times.cast("bigint"))


def taken(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED, fold: int = FOLD) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of each document, repeats counted."""
    rows = written(sized(docs, seed), "sized")
    return _repeated(rows, *plan(rows, max_epochs, fold)).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED, fold: int = FOLD) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it; documents taken no time are gone."""
    rows = written(sized(docs, seed), "sized")
    mix, several = plan(rows, max_epochs, fold)
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.coalesce("source", F.lit("")).alias("s"), F.isnull("source").alias("none"), _order(seed).alias("place"),
        words_in(F.col("text")).alias("size"))
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("times"))
    return _repeated(keyed, mix, several).where("times > 0").select("row", F.explode(copies)).select("row.*")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|{SEED}|', md5(coalesce(text, '')))) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), w AS (
  SELECT source, source_size, r, (r - 1) % 3 + 1 AS weight, {MAX_EPOCHS} * source_size AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(cap) OVER e AS DOUBLE), 0))
          / (CAST(sum(weight) OVER () AS DOUBLE) - coalesce(CAST(sum(weight) OVER e AS DOUBLE), 0)) AS level
  FROM w WINDOW e AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM l
), x AS (
  SELECT *, floor(target / greatest(source_size, 1)) AS whole,
         CAST(floor((target / greatest(source_size, 1) - floor(target / greatest(source_size, 1))) * source_size) AS BIGINT) AS gap FROM t
), u AS (
  SELECT source, place, size, CAST(sum(size) AS BIGINT) AS words FROM d WHERE size > 0 GROUP BY ALL
), f AS (
  SELECT u.source, any_value(whole) AS whole,
         list_reduce(list({{'pass': pass, 'place': place, 'size': size, 'words': words}} ORDER BY pass, place, size),
           lambda a, b: CASE WHEN b.words <= a.gap THEN {{'gap': a.gap - b.words, 'took': list_append(a.took, b.place || b.size)}} ELSE a END,
           {{'gap': any_value(gap), 'took': CAST([] AS VARCHAR[])}}) AS walk
  FROM u JOIN x ON u.source IS NOT DISTINCT FROM x.source, (SELECT unnest(range(1, {MAX_EPOCHS} + 1)) AS pass) WHERE whole + pass <= {MAX_EPOCHS} GROUP BY u.source
), p AS (
  SELECT u.source, u.place, u.size, len(list_filter(walk.took, lambda y: y = u.place || u.size)) AS more,
         whole + more < {MAX_EPOCHS} AS may, may AND row_number() OVER (PARTITION BY u.source, may ORDER BY words, u.place, u.size) = 1 AND words < 2 * walk.gap AS added
  FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source
)
SELECT d.doc_id, d.source, d.size, x.source_size, x.target, CAST(d.size * (whole + coalesce(more + CAST(added AS INT), 0)) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.place = d.place AND p.size = d.size
"""
