"""The registry of known people and projects, and look-ups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.operators.entities import detect_entities
from loci.schemas import PEOPLE, conform


def seed_people(people: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """People rows from (name, relationship, context, ord) and aliases (alias, canonical).

    An alias becomes a person of its own, right after its canonical name.
    """
    base = people.withColumn("name", tx.strip(F.col("name"))).where(F.col("name") != "")
    base = base.withColumn("context", F.coalesce("context", F.lit("personal"))).withColumn("relationship", F.coalesce("relationship", F.lit("")))
    if aliases is not None:
        base = base.join(aliases.select(F.col("canonical").alias("name"), "alias"), "name", "left")
    else:
        base = base.withColumn("alias", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    main = base.select(
        "name", (F.col("ord") * 2).alias("ord"), F.lit("onboarding").alias("source"), F.array("context").alias("contexts"),
        F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(none).alias("aliases"), "relationship",
        F.lit(1.0).alias("confidence"),
    )
    extra = base.where(F.col("alias").isNotNull()).select(
        F.col("alias").alias("name"), (F.col("ord") * 2 + 1).alias("ord"), F.lit("onboarding").alias("source"),
        F.array("context").alias("contexts"), F.array("name").alias("aliases"), "relationship",
        F.lit(1.0).alias("confidence"), F.col("name").alias("canonical"),
    )
    return conform(main, PEOPLE).unionByName(conform(extra, PEOPLE))


def is_ambiguous(word: Column) -> Column:
    return F.lower(word).isin(list(fixed.AMBIGUOUS_WORDS))


def ambiguous_flags(people: DataFrame) -> DataFrame:
    return people.where(is_ambiguous(F.col("name"))).select(F.lower("name").alias("word")).distinct()


def disambiguate(df: DataFrame, word: str, context: str, only: Column | None = None) -> DataFrame:
    """Add person_hits and concept_hits: context patterns for and against a name.

    With ``only``, other rows get 0 and their patterns are never tried.
    """
    name, low = F.lower(word), F.lower(context)
    hits = {
        "person_hits": tx.match_named(low, tx.name_patterns(fixed.PERSON_CONTEXTS), name),
        "concept_hits": tx.match_named(low, tx.name_patterns(fixed.CONCEPT_CONTEXTS), name),
    }
    return tx.computed(df, {k: v if only is None else F.when(only, v).otherwise(0) for k, v in hits.items()})


def _names(people: DataFrame) -> DataFrame:
    """First person per lower-cased name or alias."""
    every = people.withColumn("_key", F.explode(F.array_distinct(F.concat(
        F.array(F.lower("name")), F.transform(F.coalesce("aliases", F.array()), lambda a: F.lower(a))
    ))))
    first = every.groupBy("_key").agg(F.min_by(F.struct("name", "source", "confidence", "contexts"), "ord").alias("_person"))
    return first


# Registered keys that are sent to the words, which then stay where they are; a longer registry is joined by a shuffle.
MAX_BROADCAST = 100_000


def _sent(keys: DataFrame) -> DataFrame:
    """A registry's keys, marked to be sent whole where they are few; Spark cannot tell their number."""
    return F.broadcast(keys) if keys.select("_key").limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else keys


def _known(people: DataFrame, projects: DataFrame | None, wiki: DataFrame | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """One row per registered key (_key) of people, projects and confirmed research."""
    if projects is not None:
        projects = projects.groupBy(F.lower("name").alias("_key")).agg(F.min_by("name", "ord").alias("_project"))
    if wiki is not None:
        wiki = wiki.where("confirmed").groupBy(F.lower("word").alias("_key")).agg(
            F.min_by(F.struct("inferred_type", "confidence"), "word").alias("_wiki")
        )
    return _names(people), projects, wiki


class Table:
    """A registry short enough to be sent along: ``lookup`` for single words, in Python."""

    def __init__(self, people: dict, projects: dict, wiki: dict):
        self.people, self.projects, self.wiki = people, projects, wiki
        # Words that ``lookup`` decides by their context.
        self.ambiguous = sorted(set(people) & set(fixed.AMBIGUOUS_WORDS))

    def find(self, word: str, person_hits: int = 0, concept_hits: int = 0) -> tuple:
        """(type, confidence, entity_name) of a word, as ``lookup`` gives them; the hits are those of an ambiguous word."""
        key = word.lower()
        if key in self.people:
            if concept_hits > person_hits:
                return "concept", min(0.9, 0.7 + concept_hits * 0.1), word
            if person_hits > concept_hits:
                return "person", min(0.95, 0.7 + person_hits * 0.1), word
            name, confidence = self.people[key]
            return "person", confidence, name
        if key in self.projects:
            return "project", 1.0, self.projects[key]
        return (*self.wiki.get(key, ("unknown", 0.0)), word)


def table(people: DataFrame, projects: DataFrame | None = None, wiki: DataFrame | None = None) -> Table | None:
    """The registry as a ``Table``, or nothing if any part has more than MAX_BROADCAST keys."""
    found = []
    parts = zip(_known(people, projects, wiki), ("_person", "_project", "_wiki"), (["_person.name", "_person.confidence"], ["_project"], ["_wiki.*"]))
    for part, value, fields in parts:
        # A key without a value is as good as none, as in a join.
        rows = [] if part is None else part.where(F.col(value).isNotNull()).select("_key", *fields).limit(MAX_BROADCAST + 1).collect()
        if len(rows) > MAX_BROADCAST:
            return None
        found.append({r[0]: r[1] if len(r) == 2 else tuple(r[1:]) for r in rows if r[0] is not None})
    return Table(*found)


def context_hits(words: Column, context: Column, ambiguous: list[str]) -> Column:
    """JSON list of (word, person_hits, concept_hits) of the words of a row that are ambiguous (see ``disambiguate``), or null."""
    low = F.lower(context)

    def hits(w: Column) -> Column:
        found = {n: tx.match_named(low, tx.name_patterns(p), F.lower(w)) for n, p in (("person_hits", fixed.PERSON_CONTEXTS), ("concept_hits", fixed.CONCEPT_CONTEXTS))}
        return F.struct(w.alias("word"), *[c.cast("int").alias(n) for n, c in found.items()])

    # Most texts have no such word at all.
    some = F.rlike(low, F.lit("|".join(ambiguous)))
    return F.when(some, F.to_json(F.transform(F.filter(words, lambda w: F.lower(w).isin(ambiguous)), hits)))


def lookup(
    words: DataFrame, people: DataFrame, projects: DataFrame | None = None, wiki: DataFrame | None = None,
    word: str = "word", context: str = "context",
) -> DataFrame:
    """Classify words: (.., type, confidence, entity_source, entity_name, disambiguated_by).

    People (by name or alias, first registered wins) come before projects, and
    those before confirmed research.  A name that is also a common word is
    decided by its context if there is one; a tie stays a person.
    """
    if context not in words.columns:
        words = words.withColumn(context, F.lit(""))
    df = words.withColumn("_key", F.lower(word))
    missing = ("_person", None), ("_project", "string"), ("_wiki", "struct<inferred_type:string,confidence:double>")
    for known, (name, kind) in zip(_known(people, projects, wiki), missing):
        df = df.withColumn(name, F.lit(None).cast(kind)) if known is None else df.join(_sent(known), "_key", "left")
    # Flags are kept for registered names, aliases included.
    flagged = F.col("_person").isNotNull() & is_ambiguous(F.col(word)) & (F.col(context) != "")
    df = disambiguate(df, word, context, flagged)
    as_person = flagged & (F.col("person_hits") > F.col("concept_hits"))
    as_concept = flagged & (F.col("concept_hits") > F.col("person_hits"))
    person = F.col("_person")
    return df.select(
        *words.columns,
        F.when(as_concept, "concept").when(person.isNotNull(), "person").when(F.col("_project").isNotNull(), "project")
        .when(F.col("_wiki").isNotNull(), F.col("_wiki.inferred_type")).otherwise("unknown").alias("type"),
        F.when(as_concept, F.least(F.lit(0.9), 0.7 + F.col("concept_hits") * 0.1))
        .when(as_person, F.least(F.lit(0.95), 0.7 + F.col("person_hits") * 0.1))
        .when(person.isNotNull(), person["confidence"]).when(F.col("_project").isNotNull(), F.lit(1.0))
        .when(F.col("_wiki").isNotNull(), F.col("_wiki.confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(as_concept, "context_disambiguated").when(person.isNotNull(), person["source"])
        .when(F.col("_project").isNotNull(), "onboarding").when(F.col("_wiki").isNotNull(), "wiki").otherwise("none").alias("entity_source"),
        F.when(as_concept | as_person, F.col(word)).when(person.isNotNull(), person["name"])
        .when(F.col("_project").isNotNull(), F.col("_project")).otherwise(F.col(word)).alias("entity_name"),
        F.when(as_concept | as_person, "context_patterns").alias("disambiguated_by"),
    )


def people_in_queries(queries: DataFrame, people: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """Registered people that queries mention: (key, canonical).

    Names are matched as whole words.  Word n-grams of a query, up to the
    longest registered name, are looked up by equality, so the registry may
    be large.
    """
    def tokens(c):
        return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")

    named = people.withColumn("_alias", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array())))).select(
        F.col("name").alias("canonical"), "_alias", F.array_join(tokens(F.col("_alias")), " ").alias("_gram"), F.size(tokens(F.col("_alias"))).alias("_n")
    ).where(F.col("_n") > 0)
    # Names have a handful of different lengths; each is one n-gram size.
    sizes = [r[0] for r in named.select("_n").distinct().collect()] or [1]
    cut = queries.withColumn("_t", tokens(F.col(text))).withColumn("_n", F.explode(F.array(*[F.lit(n) for n in sorted(sizes)])))
    cut = cut.where(F.size("_t") >= F.col("_n"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_t") - F.col("_n") + 1), lambda i: F.array_join(F.slice("_t", i, F.col("_n")), " "))
    hits = cut.select(key, text, F.explode(F.array_distinct(grams)).alias("_gram")).join(named.drop("_n"), "_gram")
    judged = disambiguate(hits, "_alias", text, is_ambiguous(F.col("_alias")))
    kept = judged.where(~is_ambiguous(F.col("_alias")) | (F.col("person_hits") > F.col("concept_hits")))
    return kept.select(key, "canonical").distinct()


def unknown_candidates(queries: DataFrame, people: DataFrame, projects: DataFrame | None = None, wiki=None,
                       key: str = "query_id", text: str = "query") -> DataFrame:
    """Capitalised words of queries that nothing is known about."""
    pattern = r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,15})(?![A-Za-z0-9_])"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    words = queries.select(key, F.explode(found).alias("word")).where(~is_ambiguous(F.col("word")))
    return lookup(words, people, projects, wiki).where(F.col("type") == "unknown").select(key, "word")


def learn(people: DataFrame, docs: DataFrame, projects: DataFrame | None = None, mode: str = "personal",
          min_confidence: float = 0.75, text: str = "document", key: str = "original_id", stopwords=None) -> DataFrame:
    """New people found in texts with enough confidence (the surest sighting of each)."""
    seen = detect_entities(docs, text, key, stopwords).where(
        (F.col("type") == "person") & (F.col("confidence") >= min_confidence)
    )
    seen = seen.join(people.select("name"), "name", "left_anti")
    if projects is not None:
        seen = seen.join(projects.select("name"), "name", "left_anti")
    best = seen.groupBy("name").agg(F.max("confidence").alias("confidence"), F.sum("frequency").alias("seen_count"))
    start = F.coalesce(people.agg(F.max("ord")).scalar(), F.lit(0))
    return conform(best.select(
        "name", (start + 1).alias("ord"), F.lit("learned").alias("source"),
        F.array(F.lit(mode if mode != "combo" else "personal")).alias("contexts"),
        F.array().cast("array<string>").alias("aliases"), F.lit("").alias("relationship"), "confidence", "seen_count",
    ), PEOPLE)


def classify_research(pages: DataFrame) -> DataFrame:
    """Type of researched words from encyclopedia summaries.

    ``pages`` has (word, status, page_type, title, description, extract): the
    answer of a summary service, fetched elsewhere.
    """
    low = F.lower(F.coalesce("extract", F.lit("")))
    word = F.lower("word")
    desc = F.lower(F.coalesce("description", F.lit("")))
    named = F.rlike(low, F.lit("|".join(fixed.NAME_PHRASES)))
    placed = F.rlike(low, F.lit("|".join(fixed.PLACE_PHRASES)))
    direct = F.contains(low, F.concat(word, F.lit(" is a"))) | F.contains(low, F.concat(word, F.lit(" (name")))
    disambiguation = F.col("page_type") == "disambiguation"
    missing, failed = F.col("status") == 404, F.col("status") != 200
    kind = (
        F.when(missing, "person").when(failed, "unknown")
        .when(disambiguation & F.contains(desc, F.lit("name")), "person").when(disambiguation, "ambiguous")
        .when(named, "person").when(placed, "place").otherwise("concept")
    )
    confidence = (
        F.when(missing, 0.70).when(failed, 0.0)
        .when(disambiguation & F.contains(desc, F.lit("name")), 0.65).when(disambiguation, 0.4)
        .when(named & direct, 0.90).when(named, 0.80).when(placed, 0.80).otherwise(0.60)
    )
    ok = F.col("status") == 200
    return pages.select(
        "word", kind.alias("inferred_type"), confidence.alias("confidence"),
        F.when(ok, F.left(low, F.lit(200))).alias("wiki_summary"),
        F.when(ok, F.coalesce("title", "word")).alias("wiki_title"), F.lit(False).alias("confirmed"),
    )


def confirm(people: DataFrame, wiki: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark researched words as confirmed and add people: (people, wiki) after it.

    ``confirmed`` has (word, entity_type, relationship, context).
    """
    marked = wiki.join(confirmed.select("word", "entity_type"), "word", "left").withColumn(
        "confirmed", F.col("confirmed") | F.col("entity_type").isNotNull()
    ).withColumnRenamed("entity_type", "confirmed_type")
    start = F.coalesce(people.agg(F.max("ord")).scalar(), F.lit(0))
    new = confirmed.where(F.col("entity_type") == "person").select(
        F.col("word").alias("name"), (start + 1).alias("ord"), F.lit("wiki").alias("source"),
        F.array(F.coalesce("context", F.lit("personal"))).alias("contexts"), F.array().cast("array<string>").alias("aliases"),
        F.coalesce("relationship", F.lit("")).alias("relationship"), F.lit(0.9).alias("confidence"),
    )
    rest = people.join(new.select("name"), "name", "left_anti").select(people.columns)
    return rest.unionByName(conform(new, PEOPLE)), marked


def summary(people: DataFrame, projects: DataFrame, wiki: DataFrame | None = None, mode: str = "personal") -> DataFrame:
    """The registry's figures as (line, value) rows."""
    spark = people.sparkSession
    n = people.agg(F.count("*").alias("n"), F.count_if(is_ambiguous(F.col("name"))).alias("a"))
    rows = n.select(F.explode(F.array(
        F.struct(F.lit("People").alias("line"), F.col("n").alias("value")),
        F.struct(F.lit("Ambiguous flags").alias("line"), F.col("a").alias("value")),
    )).alias("r")).select("r.*")
    rows = rows.unionByName(projects.agg(F.lit("Projects").alias("line"), F.count("*").alias("value")))
    cached = wiki.agg(F.lit("Wiki cache").alias("line"), F.count("*").alias("value")) if wiki is not None else (
        spark.range(1).select(F.lit("Wiki cache").alias("line"), F.lit(0).cast("bigint").alias("value"))
    )
    return rows.unionByName(cached).withColumn("mode", F.lit(mode))
