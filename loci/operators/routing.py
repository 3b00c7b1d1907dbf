"""Which palace does a text belong to: ranking, quality, fallback, memory."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loci.functions import fixed
from loci.functions import text as tx
from loci.functions import vectors as vec
from loci.session import kept

# Registry rows are put into the plan as one literal of at most this size; a
# longer registry is cut into several.
REGISTRY_BYTES = 4 * 1024 * 1024

_FIELD_WEIGHTS = (("name", 0.08), ("description", 0.12), ("scope", 0.16), ("l0_body", 0.12))
_PACKED = "array<struct<name:string,usage_count:bigint,usage_boost:double>>"


# --- score parts -----------------------------------------------------------------


def usage_boost(count: Column) -> Column:
    n = F.coalesce(count.cast("double"), F.lit(0.0))
    return F.when(n > 0, F.least(F.lit(0.12), F.log1p(n) * 0.02)).otherwise(F.lit(0.0))


class Fields:
    """Texts of the palaces of a registry, indexed by word, to be compared with many contexts.

    A palace has ``fields`` (dicts of text and weight) and ``keywords`` (texts), all normalised and none empty.
    """

    def __init__(self, palaces: list[dict]):
        self.palaces = len(palaces)
        fields = [(i, n, f["text"], f["weight"]) for i, p in enumerate(palaces) for n, f in enumerate(p["fields"])]
        keywords = [(i, n, k) for i, p in enumerate(palaces) for n, k in enumerate(p["keywords"])]
        texts = [f[2] for f in fields]
        self.fields, self.size = len(fields), len(fields) + len(keywords)
        self.weights = np.array([f[3] for f in fields])
        self.field_turns = self._turns([f[:2] for f in fields])
        self.keyword_turns = self._turns([k[:2] for k in keywords])
        self.holding, self.keywords = defaultdict(list), defaultdict(list)
        for at, text in enumerate(texts + [k[2] for k in keywords]):
            for word in set(text.split()):
                self.holding[word].append(at)
        for at, k in enumerate(keywords):
            self.keywords[k[2]].append(at)
        self.holding = {w: np.array(at) for w, at in self.holding.items()}
        words = {w for t in texts for w in t.split()}
        self.heads = {w[:n] for w in words for n in range(1, len(w) + 1)}
        self.tails = {w[n:] for w in words for n in range(len(w))}
        self.joined = "\n".join(texts)
        self.starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.seen: dict[str, np.ndarray] = {}

    @staticmethod
    def _turns(owners: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place, palace) of every first field, of every second and so on: sums are built up in that order."""
        turns = defaultdict(list)
        for at, (palace, n) in enumerate(owners):
            turns[n].append((at, palace))
        return [tuple(np.array(c) for c in zip(*turns[n])) for n in sorted(turns)]

    def _containing(self, phrase: str) -> np.ndarray:
        """Fields whose text contains a phrase, whose first and last word may be parts of words there."""
        found, at = [], self.joined.find(phrase)
        while at >= 0:
            found.append(int(np.searchsorted(self.starts, at, side="right")) - 1)
            # One hit per field is enough.
            at = self.joined.find(phrase, int(self.starts[found[-1] + 1])) if found[-1] + 1 < self.fields else -1
        return np.array(found, np.int64)

    def _pair(self, first: str, second: str) -> np.ndarray | None:
        if first not in self.tails or second not in self.heads:
            return None
        pair = f"{first} {second}"
        if pair not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[pair] = self._containing(pair)
        return self.seen[pair] if len(self.seen[pair]) else None

    def boosts(self, normalized: str) -> np.ndarray:
        """Text agreement of a context with every palace, at most 0.25.

        Fields count the share of the context's distinct words that they have and of its phrases (all of it, and
        every pair of neighbours) that they contain; a keyword gives 0.14 if it is such a phrase, else 0.08 x its share.
        """
        words = normalized.split()
        if not words:
            return np.zeros(self.palaces)
        tokens, pairs = set(words), set(zip(words, words[1:]))
        phrases = {f"{a} {b}" for a, b in pairs} | {normalized}
        at = [self.holding[w] for w in tokens if w in self.holding]
        overlap = (np.bincount(np.concatenate(at), minlength=self.size) if at else np.zeros(self.size)) / len(tokens)
        hits = [self._pair(a, b) for a, b in pairs]
        if len(words) != 2 and all(h is not None for h in hits):
            # A text is only contained where each of its pairs is.
            hits.append(self._containing(normalized))
        hits = [h for h in hits if h is not None and len(h)]
        inside = (np.bincount(np.concatenate(hits), minlength=self.fields) if hits else np.zeros(self.fields)) / len(phrases)
        score = np.minimum(self.weights, overlap[:self.fields] * self.weights * 0.6 + inside * self.weights * 0.4)
        share = overlap[self.fields:] * 0.08
        for phrase in phrases:
            if phrase in self.keywords:
                share[self.keywords[phrase]] = 0.14
        total, extra = np.zeros(self.palaces), np.zeros(self.palaces)
        for places, palaces in self.field_turns:
            total[palaces] += score[places]
        for places, palaces in self.keyword_turns:
            extra[palaces] += share[places]
        return np.minimum(0.25, total + np.minimum(0.18, extra))


def field_boosts(normalized: Column, palaces: list[dict], spark) -> Column:
    """array<double> of the text agreement of a normalised context with every palace (see ``Fields``)."""
    shared = spark.sparkContext.broadcast(palaces)

    @pandas_udf("array<double>")
    def boosts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fields = Fields(shared.value)
        for texts in batches:
            yield pd.Series([fields.boosts(t) for t in texts])

    return boosts(normalized)


# --- ranking ----------------------------------------------------------------------


def _registry(palaces: DataFrame) -> DataFrame:
    """Palaces with their texts normalised and their boost computed."""
    have = set(palaces.columns)

    def col(name, kind="string"):
        return F.col(name) if name in have else F.lit(None).cast(kind)

    fields = F.array(*[
        F.struct(tx.normalize_text(col(n)).alias("text"), F.lit(w).alias("weight")) for n, w in _FIELD_WEIGHTS
    ])
    joined = F.array_join(F.transform(F.coalesce(col("keywords", "array<string>"), F.array()), lambda k: F.concat(k, F.lit(""))), "\n")
    keywords = F.filter(F.split(_normalize_lines(joined), "\n"), lambda k: k != "")
    return palaces.select(
        "name",
        F.coalesce(col("usage_count", "bigint"), F.lit(0)).cast("bigint").alias("usage_count"),
        usage_boost(col("usage_count", "bigint")).alias("usage_boost"),
        fields.alias("fields"), keywords.alias("keywords"), "vector",
    )


def _normalize_lines(c: Column) -> Column:
    folded = tx.fold_accents(F.lower(c))
    flat = F.regexp_replace(folded, r"[^a-z0-9\n]+", " ")
    return F.regexp_replace(flat, r"(?m)^ +| +$", "")


def _registry_slices(palaces: DataFrame):
    """The registry in driver-sized pieces: (packed JSON literal, texts, unit matrix)."""
    reg = _registry(palaces).withColumn(
        "_bytes", F.length(F.to_json(F.struct("name", "fields", "keywords"))) + F.size("vector") * 8
    )
    # Measured first and then fetched piece by piece.
    reg = kept(reg)
    total = reg.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(1, -(-int(total) // REGISTRY_BYTES))
    for i in range(parts):
        piece = reg if parts == 1 else reg.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i)
        rows = piece.orderBy("name").collect()
        if not rows:
            continue
        packed = [{"name": r["name"], "usage_count": r["usage_count"], "usage_boost": r["usage_boost"]} for r in rows]
        texts = [
            {"fields": [{"text": f["text"], "weight": f["weight"]} for f in r["fields"] if f["text"]], "keywords": r["keywords"]}
            for r in rows
        ]
        yield F.from_json(F.lit(json.dumps(packed)), _PACKED), texts, vec.unit_rows([r["vector"] for r in rows])


def rank_palaces(
    contexts: DataFrame, palaces: DataFrame, *, text: str | None = "text", vector: str = "vector",
    limit: int | None = None, current: str | None = None,
) -> DataFrame:
    """Palaces ranked for every context, as an added array column.

    ``candidates`` is array<struct<rank_key, name, score, semantic_score,
    field_boost, usage_boost, usage_count>>, best first.  With ``limit`` only
    the semantically nearest palaces are taken (before boosts), as a
    nearest-neighbour search would.  Without a ``text`` column the field
    boost is 0.  The work stays in the context's row: no join and no shuffle.
    With ``current`` naming a column, ``current_score`` is that palace's score.
    """
    spark = contexts.sparkSession
    df = contexts
    if text is not None:
        df = df.withColumn("_norm", tx.normalize_text(F.col(text)))
    arrays = []
    for i, (packed, texts, matrix) in enumerate(_registry_slices(palaces)):
        df = df.withColumn(f"_sem{i}", vec.candidate_scores(F.col(vector), matrix, spark))
        boosts = F.transform(f"_sem{i}", lambda s: F.lit(0.0))
        if text is not None:
            df = df.withColumn(f"_boost{i}", field_boosts(F.col("_norm"), texts, spark))
            boosts = F.col(f"_boost{i}")
        parts = F.zip_with(f"_sem{i}", boosts, lambda s, f: F.struct(s.alias("s"), f.alias("f")))

        def boosted(p, x):
            return F.struct(p["name"].alias("n"), p["usage_boost"].alias("u"), p["usage_count"].alias("c"), x["s"].alias("s"), x["f"].alias("f"))

        def scored(x):
            score = x["s"] + x["f"] + x["u"]
            worst = F.lit(float("inf"))
            return F.struct(
                F.coalesce(-score, worst).alias("order_score"), F.coalesce(-x["s"], worst).alias("order_semantic"),
                x["n"].alias("name"), score.alias("score"), x["s"].alias("semantic_score"), x["f"].alias("field_boost"),
                x["u"].alias("usage_boost"), x["c"].alias("usage_count"),
            )

        arrays.append(F.transform(F.zip_with(packed, parts, boosted), scored))
    if not arrays:
        empty = (
            "array<struct<order_score:double,order_semantic:double,name:string,score:double,"
            "semantic_score:double,field_boost:double,usage_boost:double,usage_count:bigint>>"
        )
        ranked = F.array().cast(empty)
    else:
        ranked = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
        if limit is not None:
            nearest = F.array_sort(
                F.transform(ranked, lambda c: F.struct(c["order_semantic"].alias("k"), c["name"].alias("n"), c.alias("c")))
            )
            ranked = F.transform(F.slice(nearest, 1, limit), lambda x: x["c"])
        ranked = F.array_sort(ranked)
    df = tx.computed(df, {"candidates": ranked})
    if current is not None:
        own = F.filter(F.col("candidates"), lambda c: c["name"] == F.col(current))
        df = df.withColumn("current_score", F.get(own, F.lit(0))["score"])
    return df.drop("_norm", *[f"{c}{i}" for c in ("_sem", "_boost") for i in range(len(arrays))])


def best_palace(contexts: DataFrame, palaces: DataFrame, default: str = fixed.DEFAULT_PALACE, **kw) -> DataFrame:
    """The semantically nearest palace of every context, else the default."""
    ranked = rank_palaces(contexts, palaces, limit=1, **kw)
    name = F.get(F.col("candidates"), F.lit(0))["name"]
    return ranked.withColumn("best_palace", F.coalesce(name, F.lit(default))).drop("candidates")


def assess_explicit(rows: DataFrame, palaces: DataFrame, *, palace: str = "palace", text: str | None = "text",
                    vector: str = "vector") -> DataFrame:
    """Does the palace a row was filed under agree with the best match?"""
    ranked = rank_palaces(rows, palaces, text=text, vector=vector, current=palace)
    best = F.get(F.col("candidates"), F.lit(0))
    gap = best["score"] - F.col("current_score")
    review = F.coalesce(
        (best["name"] != F.col(palace)) & (best["score"] >= fixed.MIN_SCORE) & (gap >= fixed.MIN_GAP), F.lit(False)
    )
    nothing = F.size("candidates") == 0
    return ranked.select(
        *rows.columns,
        F.col("current_score").alias("routing_confidence"),
        F.coalesce(best["name"], F.col(palace)).alias("routing_best_palace"),
        review.alias("needs_review"),
        F.when(nothing, "no_palace_registry")
        .when(review, "explicit_palace_differs_from_semantic_best_match")
        .otherwise("explicit_palace_confirmed").alias("routing_reason"),
    )


# --- result quality -----------------------------------------------------------------


def query_aspects(normalized: Column) -> Column:
    """Distinct words of four letters or more, plus all of them joined."""
    long = F.filter(tx.words(normalized), lambda w: F.length(w) >= 4)
    whole = F.when(F.size(long) > 1, F.array(F.array_join(long, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(long, whole))


def coverage(aspects: Column, corpus: Column) -> Column:
    """Share of the aspects that the corpus contains; 1 when there are none."""
    hit = F.size(F.filter(aspects, lambda a: F.contains(corpus, a)))
    return F.when(F.size(aspects) == 0, F.lit(1.0)).otherwise(hit / F.size(aspects))


def result_quality(hits: DataFrame, queries: DataFrame, *, key: str = "query_id", query: str = "query") -> DataFrame:
    """Quality of each query's hits: best, mean of the top three, coverage, score.

    ``hits`` has (key, rank, similarity, text).  Queries without hits get null
    where the original had minus infinity.  At most five texts per query are
    gathered.
    """
    top = hits.where(F.col("rank") <= 5).groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("best_similarity"),
        F.avg(F.when(F.col("rank") <= 3, F.col("similarity"))).alias("avg_top_3_similarity"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]), " "
        ).alias("_corpus"),
    )
    joined = queries.join(top, key, "left").withColumns({
        "_query": tx.normalize_text(F.col(query)), "_corpus": tx.normalize_text(F.col("_corpus")),
    })
    joined = tx.computed(joined, {"_aspects": query_aspects(F.col("_query")), "_corpus": F.col("_corpus")})
    covered = F.when(F.col("best_similarity").isNull(), F.lit(0.0)).otherwise(
        coverage(F.col("_aspects"), F.col("_corpus"))
    )
    return joined.withColumn("answer_coverage", covered).withColumn(
        "quality_score",
        F.col("best_similarity") * 0.55 + F.col("avg_top_3_similarity") * 0.25 + F.col("answer_coverage") * 0.2,
    ).drop("_corpus", "_query", "_aspects")


def weak(score: Column, covered: Column) -> Column:
    return score.isNull() | (score < fixed.WEAK_SCORE) | (covered < fixed.WEAK_COVERAGE)


def choose_fallback(options: DataFrame, *, key: str = "query_id") -> DataFrame:
    """Best palace per query among tried ones.

    ``options`` has (key, palace, is_current, semantic_score, answer_coverage,
    quality_score).  Coverage decides, then score; the current palace and then
    the semantically nearer one win ties.  Palaces without hits lose.
    """
    order = Window.partitionBy(key).orderBy(
        F.col("quality_score").isNull().asc(), F.desc_nulls_last("answer_coverage"),
        F.desc_nulls_last("quality_score"), F.desc("is_current"), F.desc_nulls_last("semantic_score"), F.asc("palace"),
    )
    return options.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


# --- routing memory, usage ------------------------------------------------------------


def remember(events: DataFrame) -> DataFrame:
    """Routing memory from a log of (query, palace, source, ts, seq).

    One row per normalised query: the last palace and source, the number of
    times it was used, the latest time.
    """
    keyed = events.withColumn("normalized_query", tx.normalize_text(F.col("query"))).where(
        (F.col("normalized_query") != "") & F.col("palace").isNotNull()
    )
    return keyed.groupBy("normalized_query").agg(
        F.max_by("palace", "seq").alias("palace"),
        F.max_by("source", "seq").alias("source"),
        F.count("*").alias("hit_count"),
        F.max_by("ts", "seq").alias("last_used_at"),
    )


def with_usage(palaces: DataFrame, usage_events: DataFrame) -> DataFrame:
    """Palaces with usage_count and last_used_at taken from a usage log (name, ts)."""
    used = usage_events.groupBy("name").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    have = set(palaces.columns)
    base = F.coalesce(F.col("usage_count"), F.lit(0)) if "usage_count" in have else F.lit(0)
    last = F.col("last_used_at") if "last_used_at" in have else F.lit(None).cast("string")
    return (
        palaces.join(used, "name", "left")
        .withColumn("usage_count", (base + F.coalesce("_n", F.lit(0))).cast("bigint"))
        .withColumn("last_used_at", F.coalesce(F.col("_last"), last))
        .drop("_n", "_last")
    )


def list_palaces(palaces: DataFrame) -> DataFrame:
    return palaces.select(
        "name", F.nullif("description", F.lit("")).alias("description"), "keywords",
        F.nullif("wing_focus", F.lit("")).alias("wing_focus"), F.nullif("scope", F.lit("")).alias("scope"),
        "is_default", F.coalesce("usage_count", F.lit(0)).alias("usage_count"), "last_used_at",
    )


def upsert_palaces(palaces: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace or add palaces by name; usage figures of known ones are kept."""
    cols = palaces.columns
    old = palaces.select("name", F.col("usage_count").alias("_n"), F.col("last_used_at").alias("_last"))
    new = changes.join(old, "name", "left")
    kept = {
        "usage_count": F.coalesce("_n", F.lit(0)).cast("bigint"), "last_used_at": F.col("_last"),
        "scope": tx.or_default(F.col("scope"), "") if "scope" in changes.columns else F.lit(""),
    }
    kept["scope"] = F.when(kept["scope"] == "", F.col("name")).otherwise(kept["scope"])
    picked = [
        kept[c].alias(c) if c in kept else (F.col(c) if c in changes.columns else F.lit(None).cast(palaces.schema[c].dataType).alias(c))
        for c in cols
    ]
    rest = palaces.join(changes.select("name"), "name", "left_anti").select(cols)
    return rest.unionByName(new.select(picked))


def create_palace_rows(requests: DataFrame) -> DataFrame:
    """Validated palace rows from (name, description, keywords, scope, wing_focus, l0_body)."""
    clean = F.regexp_replace(F.lower(tx.strip(F.coalesce("name", F.lit("")))), r"\s+", "_")
    named = requests.withColumn("name", clean)
    scope = F.col("scope") if "scope" in requests.columns else F.lit(None).cast("string")
    return named.withColumn("error", F.when(F.col("name") == "", "name is required")).withColumn(
        "scope", tx.or_default(scope, "")
    ).withColumn("scope", F.when(F.col("scope") == "", F.col("name")).otherwise(F.col("scope")))
