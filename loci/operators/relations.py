"""From text to facts: dates, linked entities, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.functions import vectors as vec
from loci.operators import linking, registry

_NO_STRINGS = "array<string>"
_OPTIONS = "array<struct<order_score:double,i:int,j:int,n:int>>"


# --- dates --------------------------------------------------------------------------------


def explicit_dates(text: Column) -> Column:
    """YYYY-MM-DD dates, then YYYY/MM/DD ones rewritten, distinct in that order."""
    # Most texts have no date; the exact patterns are only tried on those that may.
    some = text.isNull() | F.rlike(text, F.lit(r"\d{4}[-/]\d{2}[-/]\d{2}"))
    dashed = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])(\d{4}-\d{2}-\d{2})(?![A-Za-z0-9_])"), F.lit(1))
    slashed = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])(\d{4}/\d{2}/\d{2})(?![A-Za-z0-9_])"), F.lit(1))
    found = F.array_distinct(F.concat(dashed, F.transform(slashed, lambda d: F.replace(d, F.lit("/"), F.lit("-")))))
    return F.when(some, found).otherwise(F.array().cast(_NO_STRINGS))


def relative_dates(folded: Column, reference: Column) -> Column:
    """Dates that day words (four languages) mean, seen from a reference date.

    ``folded`` is the text without accents (``fold_accents``), as a column.
    """
    plain = F.regexp_replace(F.lower(folded), "['’`]", "")
    tokens = F.filter(F.split(plain, r"[^\p{L}\p{N}_-]+"), lambda w: w != "")
    single = {k: v for k, v in fixed.RELATIVE_DAYS.items() if " " not in k}
    double = {k: v for k, v in fixed.RELATIVE_DAYS.items() if " " in k}
    days = F.create_map(*[F.lit(x) for kv in single.items() for x in kv])
    pairs = F.create_map(*[F.lit(x) for kv in double.items() for x in kv])
    # Most texts have no day word at all; they skip the walk over neighbours.
    some = F.rlike(plain, F.lit("|".join(w.split(" ")[0] for w in fixed.RELATIVE_DAYS)))
    nexts = F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), F.array(F.lit("")))

    def offset(token: Column, following: Column) -> Column:
        return F.coalesce(
            F.try_element_at(days, token), F.try_element_at(pairs, F.concat_ws(" ", token, following))
        )

    found = F.filter(F.zip_with(tokens, nexts, offset), lambda d: d.isNotNull())
    base = F.try_to_date(reference, "yyyy-MM-dd")
    return F.when(base.isNull() | ~some, F.array().cast(_NO_STRINGS)).otherwise(
        F.array_distinct(F.transform(found, lambda d: F.date_format(F.date_add(base, d), "yyyy-MM-dd")))
    )


def with_temporal(df: DataFrame, text: str, fallback: Column, reference: Column | None = None, out: str = "temporal") -> DataFrame:
    """Add struct<dates, valid_from, ended, has_explicit_date, has_relative_date>."""
    reference = fallback if reference is None else F.coalesce(reference, fallback)
    clean = F.coalesce(F.col(text), F.lit(""))
    # Plain ASCII has no accents, and need not go to Python.
    accented = F.when(F.rlike(clean, F.lit(r"[^\x00-\x7F]")), clean)
    df = df.withColumns({"_folded": F.coalesce(tx.fold_accents(accented), clean), "_explicit": explicit_dates(clean), "_fallback": fallback, "_reference": reference})
    df = df.withColumn("_dates", F.array_distinct(F.concat("_explicit", relative_dates(F.col("_folded"), F.col("_reference")))))
    dates = F.col("_dates")
    return df.withColumn(out, F.struct(
        dates.alias("dates"),
        F.coalesce(F.get(dates, F.lit(0)), F.col("_fallback")).alias("valid_from"),
        F.when(F.size(dates) > 1, F.element_at(dates, -1)).alias("ended"),
        (F.size("_explicit") > 0).alias("has_explicit_date"),
        (F.size(dates) > F.size("_explicit")).alias("has_relative_date"),
    )).drop("_folded", "_explicit", "_fallback", "_reference", "_dates")


# --- segments and entities ----------------------------------------------------------------


def segments(text: Column, least: int = fixed.SEGMENT_MIN) -> Column:
    """Lines and sentences of twelve characters or more, trimmed."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])\s+", -1)
    return F.filter(F.transform(parts, tx.strip), lambda s: F.length(s) >= least)


def quoted_phrases(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(fixed.QUOTED_PATTERN), F.lit(0))
    inner = F.transform(found, lambda q: tx.strip(F.substring(q, F.lit(2), F.length(q) - 2)))
    return F.array_distinct(F.filter(inner, lambda q: q != ""))


def candidate_tokens(text: Column) -> Column:
    """Distinct words of 2 to 64 characters between ASCII word boundaries."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"{edge}({fixed.TOKEN_PATTERN}){edge}"), F.lit(1)))


def title_case(text: Column) -> Column:
    """First letter of each word raised, the rest untouched."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def infer_type(name: Column, known: Column) -> Column:
    """A known type, else tool, org, project, person or concept by the name's form."""
    low = F.lower(name)
    org = low.isin(list(fixed.ORG_SUFFIXES)) | F.rlike(low, F.lit(" (?:" + "|".join(fixed.ORG_SUFFIXES) + ")$"))
    capital = F.rlike(name, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?![A-Za-z0-9_])"))
    few = F.size(F.split(name, r"\s+")) <= 3
    return (
        F.when(known.isNotNull() & (known != "unknown"), known)
        .when(low.isin(list(fixed.TOOL_HINTS)), "tool").when(org, "org")
        .when(F.rlike(low, F.lit(fixed.PROJECT_WORDS)), "project").when(capital & few, "person").otherwise("concept")
    )


def _with_pieces(segs: DataFrame, text: str, known: registry.Table, tokens: Column | None = None) -> DataFrame:
    """Add what ``linking`` works on: _quotable, _pieces, _hits and _tokens."""
    c = F.col(text)
    # Few texts hold quotes or a word that its context decides; patterns are only tried on those.
    cut = segs.withColumns({
        "_quotable": F.when(F.rlike(c, F.lit("[\"“”'`]")), c), "_pieces": F.regexp_replace(c, F.lit(linking.BETWEEN), F.lit(linking.MARK)),
    })
    hits = F.lit(None).cast("string")
    if known.ambiguous:
        hits = registry.context_hits(F.concat(quoted_phrases(c), candidate_tokens(c)), c, known.ambiguous)
    # Plain texts only: with a list among the columns, each row that is handed to Python costs as much as its batch has rows.
    return cut.withColumns({"_hits": hits, "_tokens": F.lit(None).cast("string") if tokens is None else F.array_join(tokens, linking.MARK)})


def _linked_rows(segs: DataFrame, known: registry.Table, key, text: str) -> DataFrame:
    """Entities of each row by itself: (*key, ord, name, type, confidence, source, _id, _last)."""
    return linking.entities(_with_pieces(segs.select(*key, F.col(text).alias("_text")), "_text", known).drop("_text"), known)


def _looked_up(segs: DataFrame, people: DataFrame, projects: DataFrame | None, wiki: DataFrame | None, key, text: str) -> DataFrame:
    """The same with ids, word by word, by joins with a registry of any length: (*key, _at, _last, _id, e)."""
    words = F.filter(candidate_tokens(F.col(text)), lambda w: ~F.lower(w).isin(list(fixed.PERSON_HINTS)))
    listed = F.concat(
        F.transform(quoted_phrases(F.col(text)), lambda p: F.struct(F.lit("quoted").alias("kind"), p.alias("word"))),
        F.transform(words, lambda w: F.struct(F.lit("candidate").alias("kind"), w.alias("word"))),
    )
    rows = segs.select(*key, F.col(text).alias("context"), F.posexplode(listed).alias("_at", "c")).select(
        *key, "context", "_at", "c.kind", "c.word"
    )
    known = registry.lookup(rows, people, projects, wiki).withColumnRenamed("confidence", "_known")
    unknown = F.col("type") == "unknown"
    base = F.when(unknown, 0.35).otherwise(F.coalesce(F.nullif("_known", F.lit(0.0)), F.lit(0.8)))
    marked = F.rlike(F.left("word", F.lit(1)), F.lit(r"\p{Lu}")) | F.lower("word").isin(list(fixed.TOOL_HINTS))
    quoted = F.col("kind") == "quoted"
    confidence = F.when(
        quoted, F.greatest(F.coalesce(F.nullif("_known", F.lit(0.0)), F.lit(0.45)), F.lit(0.55))
    ).when(marked, F.greatest(base, F.lit(fixed.ENTITY_CONFIDENCE))).otherwise(base)
    # Most words are unknown; the patterns of types are only tried on the names that are sure enough.
    sure = tx.computed(known, {"_sure": confidence}).where(F.col("_sure") >= fixed.ENTITY_CONFIDENCE)
    return tx.computed(sure, {"_kind": infer_type(F.col("entity_name"), F.col("type"))}).select(
        *key, "_at", F.col("_at").alias("_last"), F.lower("entity_name").alias("_id"),
        F.struct(
            F.when(~quoted & (F.col("_kind") == "person"), title_case(F.col("entity_name"))).otherwise(F.col("entity_name")).alias("name"),
            F.col("_kind").alias("type"), F.col("_sure").alias("confidence"),
            F.when(unknown, F.col("kind")).otherwise("registry").alias("source"),
        ).alias("e"),
    )


def with_alone(df: DataFrame, key) -> DataFrame:
    """Add _alone: is this the only row with its key?  Rows without a key count as not alone, and are not brought together."""
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    spread = F.when(missing, F.xxhash64(*[c for c, kind in df.dtypes if c not in key and not kind.startswith("map")]))
    # As one sum, no part of it is pushed below the shuffle, which both kinds of rows then share.
    return df.withColumn("_alone", F.sum(F.when(missing, 2).otherwise(1)).over(Window.partitionBy(*key, spread)) == 1)


def link_entities(
    segs: DataFrame, people: DataFrame, projects: DataFrame | None = None, wiki: DataFrame | None = None,
    key=("segment_id",), text: str = "segment",
) -> DataFrame:
    """Entities of segments, in order: (*key, ord, name, type, confidence, source).

    Quoted phrases come before words; a later form of the same name replaces
    the earlier one but keeps its place.  With fewer than two entities the
    room, closet and hall of the segment (if columns) fill up.  Segments that share a key are one.
    A registry short enough is sent along, and every segment is then worked out in its row.
    Where texts are cut after ``with_alone``, their segments' keys are not looked at again.
    """
    places = [c for c in ("room", "closet", "hall") if c in segs.columns]
    known = registry.table(people, projects, wiki)
    if known is None or places:
        return _linked_by_key(segs, known, people, projects, wiki, key, text)
    told = segs.select(*key, text, "_alone") if "_alone" in segs.columns else with_alone(segs.select(*key, text), key)
    shared = _linked_by_key(told.where(~F.col("_alone")), known, people, projects, wiki, key, text)
    return _linked_rows(told.where("_alone"), known, key, text).drop("_id", "_last").unionByName(shared)


def _linked_by_key(segs: DataFrame, known: registry.Table | None, people, projects, wiki, key, text: str) -> DataFrame:
    """Entities of segments that may share a key, and of their places."""
    places = [c for c in ("room", "closet", "hall") if c in segs.columns]
    if known is None:
        named = _looked_up(segs, people, projects, wiki, key, text)
    else:
        named = _linked_rows(segs, known, key, text).select(
            *key, F.col("ord").alias("_at"), "_last", "_id", F.struct("name", "type", "confidence", "source").alias("e"))
    merged = named.groupBy(*key, "_id").agg(F.min("_at").alias("ord"), F.max_by("e", "_last").alias("e"))
    out = merged.select(*key, "ord", "e.*")
    if not places:
        return out
    counted = merged.groupBy(*key).agg(F.count("*").alias("_n"), F.collect_set("_id").alias("_ids"))
    # Only segments with at most one entity are filled, so the set above is tiny for them.
    few = segs.join(counted, list(key), "left").where(F.coalesce("_n", F.lit(0)) < 2)
    fill = few.select(*key, "_ids", F.posexplode(F.array(*places)).alias("p", "name")).where(
        F.col("name").isNotNull() & (F.col("name") != "") & ~F.coalesce(F.array_contains("_ids", F.lower("name")), F.lit(False))
    )
    first = fill.groupBy(*key, F.lower("name").alias("_id")).agg(F.min("p").alias("p"), F.min_by("name", "p").alias("name"))
    return out.unionByName(first.select(
        *key, (F.lit(1_000_000) + F.col("p")).alias("ord"), "name",
        infer_type(F.col("name"), F.lit(None).cast("string")).alias("type"), F.lit(0.5).alias("confidence"), F.lit("taxonomy").alias("source"),
    ))


# --- relations ------------------------------------------------------------------------------


def prototypes(spark) -> DataFrame:
    """The 44 example sentences: (predicate, mode, text, vector)."""
    rows = [(p["id"], mode, t) for p in fixed.PREDICATES for mode in ("active", "ended") for t in p[mode]]
    return spark.createDataFrame(rows, "predicate string, mode string, text string").withColumn("vector", vec.embed(F.col("text")))


def with_predicate_scores(df: DataFrame, vector: str | None, protos: DataFrame, out: str, text: str | None = None) -> DataFrame:
    """Add array<struct<active, ended>>: the best example per predicate and mode, at least 0; of a vector, or of a text that is embedded."""
    rows = protos.orderBy("predicate", "mode", "text").collect()
    matrix = vec.unit_rows([r["vector"] for r in rows])
    scores = vec.embedded_scores(F.col(text), matrix, df.sparkSession) if text else vec.candidate_scores(F.col(vector), matrix, df.sparkSession)
    scored = df.withColumn("_protos", scores)

    def best(predicate, mode):
        at = [i + 1 for i, r in enumerate(rows) if (r["predicate"], r["mode"]) == (predicate, mode)]
        # The rows are sorted, so those of one predicate and mode are neighbours.
        return F.greatest(F.lit(0.0), F.array_max(F.slice("_protos", at[0], len(at))))

    made = F.array(*[
        F.struct(best(p["id"], "active").alias("active"), best(p["id"], "ended").alias("ended")) for p in fixed.PREDICATES
    ])
    return scored.withColumn(out, made).drop("_protos")


def type_score(predicate: dict, subject: Column, obj: Column) -> Column:
    fits = (subject.isin(*predicate["subjects"], "unknown")) & (obj.isin(*predicate["objects"], "unknown"))
    return F.when(fits, 1.0).when((subject == "unknown") | (obj == "unknown"), 0.82).otherwise(0.35)


def extract_facts(
    docs: DataFrame, people: DataFrame, projects: DataFrame | None = None, wiki: DataFrame | None = None, *,
    key: str = "original_id", text: str = "document", filed_at: str | None = "filed_at", protos: DataFrame | None = None,
    most_entities: int | None = None,
) -> DataFrame:
    """The best relation of every segment, once per text.

    Per segment its entities (all, or the first ``most_entities``; six is
    usual) are paired in both orders and scored against six predicates.  A
    score grows with the confidence of both and depends on nothing else but their
    types, so of each type only the two surest entities (the first ones, where equally
    sure) can be in the best pair, and no more are paired.  A registry short enough is sent along: segments are then
    linked, embedded and paired in one step in their row, but for texts that share a key, whose entities are one set.
    """
    spark = docs.sparkSession
    protos = prototypes(spark) if protos is None else protos
    fallback = F.left(F.col(filed_at).cast("string"), F.lit(10)) if filed_at else F.lit(None).cast("string")
    places = [c for c in ("room", "closet", "hall") if c in docs.columns]
    # A segment without a key finds no entities in the end.
    named = docs.where(F.col(key).isNotNull()).select(key, *places, fallback.alias("_day"), F.col(text).alias("_text"))
    known = registry.table(people, projects, wiki)
    if known is None or places:
        return _first_facts(_facts_of_keys(named, key, known, people, projects, wiki, protos, most_entities), key)
    told = with_alone(named, [key])
    shared = _facts_of_keys(told.where(~F.col("_alone")).drop("_alone"), key, known, people, projects, wiki, protos, most_entities)
    alone = _facts_of_rows(told.where("_alone").drop("_alone"), key, known, protos, most_entities)
    # A text is on one side only, and each side lies by key already.
    return _first_facts(alone, key).unionByName(_first_facts(shared, key))


def _cut(named: DataFrame) -> DataFrame:
    return named.select(*[c for c in named.columns if c != "_text"], F.posexplode(segments(F.col("_text"))).alias("pos", "segment"))


def _facts_of_rows(named: DataFrame, key: str, known: registry.Table, protos: DataFrame, most_entities: int | None) -> DataFrame:
    """Relations of texts that have their key for themselves."""
    # A capital sigma's small letter depends on what follows the word.
    tokens = F.when(F.contains("segment", F.lit("Σ")), vec.embedding_tokens(F.col("segment")))
    segs = _with_pieces(_cut(named).select(key, "_day", "pos", "segment"), "segment", known, tokens)
    found = linking.best_facts(segs, known, protos.collect(), most_entities)
    found = found.select(key, "_day", "pos", "segment", F.struct(*found.columns[4:]).alias("_b"))
    return _timed(found, key)


def _facts_of_keys(named: DataFrame, key: str, known: registry.Table | None, people, projects, wiki, protos: DataFrame, most_entities: int | None) -> DataFrame:
    """Relations of texts that may share a key, where equal places of equal keys are one segment."""
    # Dealt once by segment, so that no step below has to shuffle its rows again.
    segs = _cut(named).repartition(key, "pos")
    linked = _linked_by_key(segs, known, people, projects, wiki, (key, "pos"), "segment")
    if most_entities is not None:
        in_order = Window.partitionBy(key, "pos").orderBy("ord")
        linked = linked.withColumn("_place", F.row_number().over(in_order)).where(F.col("_place") <= most_entities).drop("_place")
    surest = Window.partitionBy(key, "pos", "type").orderBy(F.desc("confidence"), "ord")
    linked = linked.withColumn("_place", F.row_number().over(surest)).where(F.col("_place") <= 2)
    ents = F.array_sort(F.collect_list(F.struct("ord", "name", "type", "confidence")))
    grouped = linked.groupBy(key, "pos").agg(ents.alias("_ents")).where(F.size("_ents") >= 2)
    ready = with_predicate_scores(segs.join(grouped, [key, "pos"]), None, protos, "_preds", text="segment")

    # Pairs are compared by numbers alone; names and figures are looked up for the best one only.
    means = F.transform("_preds", lambda p: F.greatest(p["active"], p["ended"]) * 0.7)
    ready = tx.computed(ready, {"_means": means})

    def fits(s, o):
        return F.array(*[type_score(p, s["type"], o["type"]) for p in fixed.PREDICATES])

    def options(i, j, sure, fit):
        scores = F.zip_with("_means", fit, lambda m, f: F.when(f >= 0.5, m + f * 0.2 + sure))
        return F.transform(scores, lambda x, n: F.struct((-x).alias("order_score"), i.alias("i"), j.alias("j"), n.alias("n")))

    def of_first(s, i):
        return F.flatten(F.transform(
            F.col("_ents"),
            lambda o, j: F.when(i != j, options(i, j, (s["confidence"] + o["confidence"]) / 2 * 0.1, fits(s, o))).otherwise(F.array().cast(_OPTIONS)),
        ))

    pairs = F.flatten(F.transform(F.col("_ents"), of_first))
    chosen = F.array_min(F.filter(pairs, lambda p: p["order_score"].isNotNull()))
    ready = tx.computed(ready, {"_c": chosen}).where(-F.col("_c.order_score") >= fixed.FACT_CONFIDENCE)
    s, o = (F.get("_ents", F.col(f"_c.{c}")) for c in "ij")
    sem = F.get("_preds", F.col("_c.n"))
    found = tx.computed(ready, {"_b": F.struct(
        F.get(F.array(*[F.lit(p["id"]) for p in fixed.PREDICATES]), F.col("_c.n")).alias("predicate"),
        s["name"].alias("subject"), s["type"].alias("subject_type"), o["name"].alias("object"), o["type"].alias("object_type"),
        (-F.col("_c.order_score")).alias("confidence"), F.greatest(sem["active"], sem["ended"]).alias("semantic_score"),
        F.get(fits(s, o), F.col("_c.n")).alias("type_score"), (sem["ended"] > sem["active"] + 0.03).alias("is_end"),
    )})
    return _timed(found, key)


def _timed(found: DataFrame, key: str) -> DataFrame:
    """Facts with their dates from segments and their best relation (_b)."""
    found = with_temporal(found, "segment", F.col("_day"), out="_time")
    ended = F.when(F.col("_b.is_end"), F.coalesce("_time.ended", "_time.valid_from"))
    return found.select(
        key, "pos", "_b.subject", "_b.subject_type", "_b.predicate", "_b.object", "_b.object_type",
        "_b.confidence", "_b.semantic_score", "_b.type_score",
        F.when(ended.isNull(), F.col("_time.valid_from")).alias("valid_from"), ended.alias("ended"), "segment",
    )


def _first_facts(facts: DataFrame, key: str) -> DataFrame:
    """Each fact of a text once, where it comes first."""
    same = [key, "subject", "predicate", "object", F.coalesce("ended", F.lit("")).alias("_e")]
    first = facts.groupBy(*same).agg(F.min_by(F.struct(*facts.columns), "pos").alias("f"))
    return first.select("f.*")
