"""Finding names in texts and telling people from projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx

_SINGLE = r"(?<![A-Za-z0-9_])([A-Z][a-z]{1,19})(?![A-Za-z0-9_])"
_MULTI = r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)(?![A-Za-z0-9_])"


def candidates(
    docs: DataFrame, text: str = "document", by=("original_id",), stopwords=None, least: int = 3,
) -> DataFrame:
    """Capitalised words and word sequences seen at least three times: (*by, name, frequency).

    ``by`` is the scope of the count: a document, a palace, or nothing.
    """
    stop = list(fixed.STOPWORDS if stopwords is None else stopwords)
    singles = F.filter(
        F.regexp_extract_all(text, F.lit(_SINGLE), F.lit(1)), lambda w: ~F.lower(w).isin(stop)
    )
    sequences = F.filter(
        F.regexp_extract_all(text, F.lit(_MULTI), F.lit(1)),
        lambda p: ~F.exists(F.split(p, r"\s+"), lambda w: F.lower(w).isin(stop)),
    )
    seen = docs.select(*by, F.explode(F.concat(singles, sequences)).alias("name"))
    return seen.groupBy(*by, "name").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


# --- signals -------------------------------------------------------------------------------


def pronoun_lines(lines: Column) -> Column:
    pronoun = "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(fixed.PRONOUNS) + ")(?![A-Za-z0-9_])"
    return F.transform(lines, lambda x: F.rlike(x, F.lit(pronoun)))


def pronoun_hits(lines: Column, flags: Column, name: Column) -> Column:
    """Lines naming the entity that have a pronoun within two lines."""
    low = F.lower(name)

    def near(i: Column) -> Column:
        first = F.greatest(i - 2, F.lit(0))
        window = F.slice(flags, first + 1, i + 3 - first)
        return F.contains(F.lower(F.element_at(lines, i + 1)), low) & F.array_contains(window, True)

    return F.size(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), near))


_SETS = {
    "_dialogue": (fixed.DIALOGUE_PATTERNS, "mi"), "_verbs": (fixed.PERSON_VERB_PATTERNS, "i"), "_project": (fixed.PROJECT_VERB_PATTERNS, "i"),
    "_single": ((fixed.DIRECT_PATTERN, fixed.VERSIONED_PATTERN, fixed.CODE_REF_PATTERN), "i"),
}
_PARTS = ["_lines", "_low", "_flags", *[f"{c}_may" for c in _SETS]]


def with_parts(docs: DataFrame, text: str = "document") -> DataFrame:
    """Add what ``score_entities`` needs of a text whatever the name: its lines, their pronouns, patterns that may match."""
    docs = tx.computed(docs, {"_lines": tx.lines_of(F.col(text)), "_low": F.lower(text)})
    return tx.computed(docs, {
        "_flags": pronoun_lines(F.col("_lines")), **{f"{c}_may": tx.may_match(F.col("_low"), patterns) for c, (patterns, _) in _SETS.items()},
    })


def score_entities(named: DataFrame, text: str = "document", name: str = "name", most: int | None = None) -> DataFrame:
    """Add person_score, project_score and the signals of each kind, all or the first ``most``.

    ``named`` has one row per (text, name), with the columns of ``with_parts`` or without.
    Patterns are built from the name in the row and run in the JVM, where the
    text has the plain words they need.
    """
    t, n = F.col(text), F.col(name)
    named = named if set(_PARTS) <= set(named.columns) else with_parts(named, text)

    def possible(c: str, patterns) -> Column:
        return F.zip_with(F.col(f"{c}_may"), tx.beside_name(F.col("_low"), patterns, n), lambda a, b: a & b)

    counted = tx.computed(named, {f"{c}_may": possible(c, patterns) for c, (patterns, _) in _SETS.items()})
    counted = tx.computed(counted, {
        **{c: tx.count_named(t, tx.name_patterns(patterns, flags), n, F.col(f"{c}_may")) for c, (patterns, flags) in _SETS.items()},
        "_pronouns": pronoun_hits(F.col("_lines"), F.col("_flags"), n),
    }).drop(*_PARTS)
    counted = counted.withColumns({c: F.get("_single", F.lit(i)) for i, c in enumerate(("_direct", "_versioned", "_code"))}).drop("_single")

    def total(c):
        return F.aggregate(c, F.lit(0), lambda a, x: a + x)

    def said(label_start, counts, label_end):
        hit = F.filter(counts, lambda x: x > 0)
        return F.transform(hit, lambda x: F.concat(label_start, F.lit("("), x.cast("string"), F.lit("x)"), label_end))

    def one(label, count):
        return said(F.lit(label + " "), F.array(count), F.lit(""))

    action = F.concat(F.lit("'"), n, F.lit(" ...' action "))
    person_signals = F.concat(
        said(F.lit("dialogue marker "), F.col("_dialogue"), F.lit("")), said(action, F.col("_verbs"), F.lit("")),
        one("pronoun nearby", F.col("_pronouns")), one("addressed directly", F.col("_direct")),
    )
    project_signals = F.concat(
        said(F.lit("project verb "), F.col("_project"), F.lit("")), one("versioned/hyphenated", F.col("_versioned")),
        one("code file reference", F.col("_code")),
    )
    return counted.withColumns({
        "person_score": total(F.col("_dialogue")) * 3 + total(F.col("_verbs")) * 2 + F.col("_pronouns") * 2 + F.col("_direct") * 4,
        "project_score": total(F.col("_project")) * 2 + F.col("_versioned") * 3 + F.col("_code") * 3,
        "person_signals": person_signals if most is None else F.slice(person_signals, 1, most),
        "project_signals": project_signals if most is None else F.slice(project_signals, 1, most),
    }).drop("_dialogue", "_verbs", "_project", "_pronouns", "_direct", "_versioned", "_code")


def classify_entities(scored: DataFrame) -> DataFrame:
    """Add type (person, project, uncertain), confidence and signals."""
    person, project = F.col("person_score"), F.col("project_score")
    total = person + project
    ratio = F.when(total > 0, person / total).otherwise(0.0)
    kinds = F.size(F.array_distinct(F.transform(
        F.col("person_signals"),
        lambda s: F.when(F.contains(s, F.lit("dialogue")), "dialogue").when(F.contains(s, F.lit("action")), "action")
        .when(F.contains(s, F.lit("pronoun")), "pronoun").otherwise("addressed"),
    )))
    sure = (ratio >= 0.7) & (kinds >= 2) & (person >= 5)
    seen = F.concat(F.lit("appears "), F.col("frequency").cast("string"), F.lit("x"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(seen))
    kind = (
        F.when(total == 0, "uncertain").when(sure, "person").when(ratio >= 0.7, "uncertain")
        .when(ratio <= 0.3, "project").otherwise("uncertain")
    )
    confidence = (
        F.when(total == 0, F.least(F.lit(0.4), F.col("frequency") / 50.0))
        .when(sure, F.least(F.lit(0.99), 0.5 + ratio * 0.5)).when(ratio >= 0.7, F.lit(0.4))
        .when(ratio <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - ratio) * 0.5)).otherwise(F.lit(0.5))
    )
    signals = (
        F.when(total == 0, F.array(F.concat(seen, F.lit(", no strong type signals"))))
        .when(sure, some("person_signals"))
        .when(ratio >= 0.7, F.concat("person_signals", F.array(F.concat(seen, F.lit(" — pronoun-only match")))))
        .when(ratio <= 0.3, some("project_signals"))
        .otherwise(F.concat(
            F.concat("person_signals", "project_signals"), F.array(F.lit("mixed signals — needs review"))
        ))
    )
    return scored.withColumns({"type": kind, "confidence": tx.round_half_up(confidence, 2), "signals": signals})


def detect_entities(docs: DataFrame, text: str = "document", key: str = "original_id", stopwords=None) -> DataFrame:
    """Typed entities of every document, with all scores."""
    found = candidates(docs, text, (key,), stopwords)
    names = found.groupBy(key).agg(F.collect_list(F.struct("name", "frequency")).alias("_names"))
    # The patterns are the work, and the texts may lie in a few large files.
    texts = docs.select(key, text).where(F.col(key).isNotNull()).repartition(key)
    named = with_parts(names.join(texts, key), text)
    named = named.select(key, F.inline("_names"), text, *_PARTS)
    return classify_entities(score_entities(named, text)).drop(text)


def best_entities(detected: DataFrame, by=("original_id",), people: int | None = None, projects: int | None = None, uncertain: int | None = None) -> DataFrame:
    """The report form: people and projects by confidence, others by frequency; of each kind all, or the best few."""
    main = F.when(F.col("type") == "uncertain", F.col("frequency").cast("double")).otherwise(F.col("confidence"))
    order = Window.partitionBy(*by, "type").orderBy(F.desc(main), F.desc("frequency"), "name")
    cap = F.when(F.col("type") == "person", F.lit(people)).when(F.col("type") == "project", F.lit(projects)).otherwise(F.lit(uncertain))
    ranked = detected.withColumn("position", F.row_number().over(order))
    return ranked.where(cap.isNull() | (F.col("position") <= cap))


def corpus_text(files: DataFrame, max_files: int | None = 10, prefix: int | None = fixed.DETECT_PREFIX_BYTES) -> DataFrame:
    """One text for setup to look at: the first bytes of the first files, or all of them.

    ``files`` has (path, content BINARY).  The sample is the feature: setup
    asks its user about names, it does not index.
    """
    head = files if max_files is None else files.orderBy("path").limit(max_files)
    content = F.col("content") if prefix is None else F.substring("content", 1, prefix)
    head = head.select("path", F.decode(content, "UTF-8").alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "t"))), lambda s: s["t"])
    return head.agg(F.array_join(parts, "\n").alias("document")).withColumn("original_id", F.lit("corpus"))
