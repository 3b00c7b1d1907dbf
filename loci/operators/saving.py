"""Filing new drawers: validation, duplicates, routing, ids, facts, diary, setup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.functions.vectors import embed
from loci.operators import facts as kg
from loci.operators import relations, routing, taxonomy
from loci.operators.search import reject_exact
from loci.operators.store import as_upserts
from loci.schemas import DRAWER_LOG, conform
from loci.session import cut_lineage


def _blank(name: str) -> Column:
    return F.coalesce(tx.strip(F.col(name)), F.lit("")) == ""


def save_error(df: DataFrame) -> Column:
    """The first thing wrong with a save request, or null."""
    importance = F.coalesce(F.col("importance").try_cast("double"), F.lit(0.0))
    path = [F.coalesce(c, F.lit("")) == "" for c in ("wing", "hall", "room", "closet")]
    return (
        F.when(_blank("content"), "content is required")
        .when(_blank("palace"), "palace is required")
        .when(path[0] | path[1] | path[2] | path[3], "wing, hall, room, and closet are required")
        .when(_blank("topic"), "topic is required (kebab-case string)")
        .when((importance < 1) | (importance > 5), "importance is required (number 1-5, where 5=critical, 3=normal, 1=trivial)")
    )


def coerce(requests: DataFrame, types: dict[str, str]) -> DataFrame:
    """Numbers that came as text, per argument type; what is not a number stays null."""
    return requests.withColumns({
        name: F.col(name).try_cast("bigint" if kind == "integer" else "double") for name, kind in types.items()
    })


def tags_text(tags: Column) -> Column:
    return F.coalesce(F.array_join(tags, ","), F.lit(""))


@dataclass
class Saved:
    """What a batch of saves comes to; every part is a DataFrame."""

    log: DataFrame        # drawer rows to append
    answers: DataFrame    # one row per request: success or why not
    palaces: DataFrame    # palaces to register
    filed: DataFrame      # the accepted requests with their ids, for save_facts


def save_batch(
    requests: DataFrame, drawers: DataFrame, palaces: DataFrame, *, version: int, now: str, added_by: str = "mcp",
) -> Saved:
    """File a batch of (seq, palace, content, wing, hall, room, closet, topic, importance, ...).

    Wrong requests and exact copies (of stored text or of an earlier request)
    are answered and dropped; the rest is routed, identified and embedded.
    """
    have = set(requests.columns)
    for name in ("project", "source", "source_file"):
        if name not in have:
            requests = requests.withColumn(name, F.lit(None).cast("string"))
    if "tags" not in have:
        requests = requests.withColumn("tags", F.array().cast("array<string>"))
    checked = requests.withColumn("error", save_error(requests))
    good = reject_exact(checked.where(F.col("error").isNull()), drawers)
    fresh = good.where(~F.col("duplicate")).drop("duplicate", "error")
    answers = checked.where(F.col("error").isNotNull()).select("seq", F.lit(False).alias("success"), "error").unionByName(
        good.select("seq", (~F.col("duplicate")).alias("success"), F.when(F.col("duplicate"), "duplicate").alias("error"))
    )

    missing = fresh.select("palace").distinct().join(palaces.select(F.col("name").alias("palace")), "palace", "left_anti")
    new_palaces = missing.select(
        F.col("palace").alias("name"), F.concat(F.lit("Auto-registered palace: "), "palace").alias("description"),
        F.replace("palace", F.lit("_"), F.lit(" ")).alias("scope"),
    ).withColumn("vector", embed(F.col("scope")))

    filed = taxonomy.assign(fresh).withColumns({f"{lv}_name": F.col(lv) for lv in taxonomy.LEVELS})
    key = F.concat(F.left("content", F.lit(100)), F.lit(now), F.lit("#"), F.col("seq").cast("string"))
    filed = filed.withColumns({
        **{lv: F.col(f"{lv}_id") for lv in taxonomy.LEVELS},
        "original_id": F.concat(F.lit("dra_"), tx.short_md5(key, 12)),
        "document": F.col("content"), "vector": embed(F.col("content")),
        "_context": F.concat_ws("\n", "content", "wing_name", "hall_name", "room_name", "closet_name"),
    })
    filed = filed.withColumn("_cv", embed(F.col("_context")))
    # A palace that this batch opens competes like any other.
    listed = ("name", "description", "keywords", "scope", "l0_body", "usage_count", "vector")
    opened = new_palaces.withColumns({
        "usage_count": F.lit(0).cast(palaces.schema["usage_count"].dataType),
        **{c: F.lit(None).cast(palaces.schema[c].dataType) for c in ("keywords", "l0_body")},
    })
    known = palaces.select(*listed).unionByName(opened.select(*listed))
    routed = routing.assess_explicit(filed, known, text="_context", vector="_cv")
    complete = routed.withColumns({
        "importance": F.col("importance").cast("double"), "project": F.coalesce("project", F.lit("")),
        "tags": tags_text(F.col("tags")), "source": tx.or_default(F.col("source"), "manual"),
        "source_file": F.coalesce("source_file", F.lit("")), "added_by": F.lit(added_by), "filed_at": F.lit(now),
        "session_date": F.left(F.lit(now), F.lit(10)),
    })
    return Saved(as_upserts(complete, version, F.col("seq")), answers, new_palaces, filed)


def save_facts(
    filed: DataFrame, triples: DataFrame, people: DataFrame, now: str, projects: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Facts found in filed drawers, reconciled in seq order: (decisions, triples afterwards)."""
    docs = filed.select(
        "seq", "document", F.lit(now).alias("filed_at"), F.col("room_name").alias("room"),
        F.col("closet_name").alias("closet"), F.col("hall_name").alias("hall"),
    )
    found = cut_lineage(relations.extract_facts(docs, people, projects, key="seq"))
    # One sequence over drawers and their segments.
    origin = filed.select("seq", F.col("original_id").alias("source_closet"), tx.namespace_id(F.col("palace")).alias("namespace"))
    numbered = found.join(origin, "seq").withColumn("seq", F.col("seq").cast("bigint") * (1 << 20) + F.col("pos"))
    decided = cut_lineage(kg.reconcile(triples, numbered))
    after, _ = kg.apply_reconciled(triples, decided, now)
    return decided, after


def file_chunks(chunks: DataFrame, *, wing: Column, room: Column, palace: Column, version: int, now: str, agent: str, **meta) -> DataFrame:
    """Log rows for chunks of files: (path, content, chunk_index)."""
    rows = chunks.withColumns({"wing": wing, "room": room, "palace": palace})
    rows = rows.withColumns({
        "original_id": tx.mined_drawer_id(F.col("wing"), F.col("room"), F.col("path"), F.col("chunk_index")),
        "document": F.col("content"), "source_file": F.col("path"), "added_by": F.lit(agent), "filed_at": F.lit(now),
        **{k: F.lit(v) for k, v in meta.items()},
    })
    return as_upserts(rows, version)


# --- diary --------------------------------------------------------------------------------


def diary_rows(entries: DataFrame, now: str, palace: str = fixed.SESSIONS_PALACE) -> DataFrame:
    """Drawer rows of diary entries (agent, entry, topic, session_id[, ts])."""
    when = F.coalesce(F.col("ts"), F.lit(now)) if "ts" in entries.columns else F.lit(now)
    rows = entries.withColumn("filed_at", when).withColumns({
        "palace": F.lit(palace), "wing": tx.agent_wing(F.col("agent")), "room": F.lit("diary"), "hall": F.lit("hall_diary"),
        "topic": F.coalesce("topic", F.lit("general")), "type": F.lit("diary_entry"), "document": F.col("entry"),
    })
    stamp = F.left(F.regexp_replace("filed_at", "[-:T]", ""), F.lit(15))
    return rows.withColumns({
        "date": F.left("filed_at", F.lit(10)),
        "original_id": F.concat_ws("_", F.lit("diary"), "wing", stamp, tx.short_md5(F.left("entry", F.lit(50)), 8)),
    }).drop("entry")


# --- session summary --------------------------------------------------------------------------


def stage_facts(requests: DataFrame, palaces: DataFrame, min_importance: int = fixed.STAGING_IMPORTANCE) -> DataFrame:
    """Facts worth keeping, routed, placed and embedded, ready to be written as JSON.

    ``requests`` has (content, topic, importance, ...).  The topic is used on
    all four levels of the path.
    """
    kept = requests.where((F.coalesce("content", F.lit("")) != "") & (F.coalesce("importance", F.lit(0)) >= min_importance))
    routed = routing.best_palace(kept.withColumn("vector", embed(F.col("content"))), palaces, text="content")
    topic = tx.or_default(F.col("topic"), "general")
    placed = routed.withColumn("palace", F.col("best_palace")).withColumns({
        lv: taxonomy.node_id(F.lit(taxonomy._PREFIX[lv]), F.col("palace"), topic) for lv in taxonomy.LEVELS
    })
    return placed.drop("best_palace")


def staged_batch(facts: DataFrame, project: str, now: str) -> DataFrame:
    """One batch document per project: its facts and a diary line.

    A batch is one session's summary, a handful of facts.
    """
    cols = [c for c in ("content", "topic", "importance", "project", "tags", "palace", "wing", "hall", "room", "closet", "vector") if c in facts.columns]
    grouped = facts.agg(
        F.collect_list(F.struct(*cols)).alias("facts"), F.count("*").alias("_n"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("topic", F.lit("")))), ", ").alias("_topics"),
    )
    line = F.concat(
        F.lit(f"[{now[:10]}] {project}: "), F.col("_n").cast("string"), F.lit(" fact(s) — "), F.col("_topics")
    )
    return grouped.where(F.col("_n") > 0).select(
        F.lit(now).alias("staged_at"), F.lit(project).alias("project"), "facts",
        F.struct(line.alias("content"), embed(line).alias("vector")).alias("diary_entry"),
    )


# --- setup --------------------------------------------------------------------------------------


PROFILE = "name string, about string, preferences array<string>, rules array<string>, language string"


def _listed(title: Column, items: Column) -> Column:
    """A title with its items below; null without items."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, F.concat(title, F.lit("\n"), lines))


def profile_drawers(users: DataFrame, now: str) -> DataFrame:
    """Drawer log rows of user profiles (name, about, preferences, rules, language): one per section that has content."""
    about = tx.or_default(tx.strip(F.col("about")), "")
    sections = F.array(*[
        F.struct(F.lit(hall).alias("hall"), F.lit(room).alias("room"), body.alias("document"))
        for (hall, room, title), body in zip(fixed.PROFILE_SECTIONS, (
            F.concat_ws("\n", F.concat(F.lit(fixed.PROFILE_SECTIONS[0][2]), "name"), F.nullif(about, F.lit(""))),
            _listed(F.format_string(fixed.PROFILE_SECTIONS[1][2], "name"), F.col("preferences")),
            _listed(F.format_string(fixed.PROFILE_SECTIONS[2][2], "name"), F.col("rules")),
        ))
    ])
    rows = users.select(F.inline(sections)).where(F.col("document").isNotNull())
    key = tx.short_md5(F.concat(F.left("document", F.lit(80)), "room"), 12)
    return as_upserts(rows.withColumns({
        "original_id": F.concat_ws("_", F.lit("setup"), "room", key), "palace": F.lit(fixed.DEFAULT_PALACE), "wing": F.lit("wing_user"),
        "importance": F.lit(5.0), "added_by": F.lit("setup"), "filed_at": F.lit(now),
    }), 1)


def profile_palace(users: DataFrame) -> DataFrame:
    """The default palace of users, with their identity text."""
    about = F.nullif(tx.or_default(tx.strip(F.col("about")), ""), F.lit(""))
    identity = F.concat_ws(
        "\n", F.lit(fixed.IDENTITY_TITLE), F.concat(F.lit("Name: "), "name"),
        F.when(F.col("language") != "English", F.concat(F.lit("Language: "), "language")), F.concat(F.lit("About: "), about),
        _listed(F.lit("\nPreferences:"), F.col("preferences")), _listed(F.lit("\nRules:"), F.col("rules")),
    )
    return users.select(
        F.lit(fixed.DEFAULT_PALACE).alias("name"), F.concat("name", F.lit(": preferences, rules and notes")).alias("description"),
        F.array().cast("array<string>").alias("keywords"), F.lit("Who the user is, how to talk to them, what rules hold, and notes of any kind.").alias("scope"),
        F.lit(None).cast("string").alias("wing_focus"), identity.alias("l0_body"), F.lit(True).alias("is_default"),
    ).withColumn("vector", embed(F.col("scope")))


def setup(spark, name: str, about: str | None = None, preferences=(), rules=(), language: str = "English", now: str = "") -> tuple[DataFrame, DataFrame]:
    """First drawers and the default palace of a user: (drawer log rows, palace row)."""
    if not (name or "").strip():
        raise ValueError("a user needs a name")
    user = spark.createDataFrame([(name, about, list(preferences), list(rules), language)], PROFILE)
    return profile_drawers(user, now), profile_palace(user)


def empty_drawers(spark) -> DataFrame:
    return conform(spark.createDataFrame([], DRAWER_LOG), DRAWER_LOG)
