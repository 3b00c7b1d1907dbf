"""Rooms, topics and memory types of texts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx


def _first_best(scores: list[tuple[str, Column]]) -> Column:
    """Name with the highest score, the first one on ties; null if none is above 0."""
    ranked = F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores)])
    best = F.array_min(ranked)
    return F.when(best["s"] < 0, best["n"])


def convo_room(content: Column, window: int | None = None, topics=None) -> Column:
    """Topic whose keywords occur most (each counted once); 'general' for none.

    ``window`` looks at the first characters only; None reads the whole text.
    """
    low = F.lower(content if window is None else F.left(content, F.lit(window)))
    scores = [
        (room, sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)))
        for room, words in (topics or fixed.CONVO_TOPICS).items()
    ]
    return F.coalesce(_first_best(scores), F.lit("general"))


def hall_of(content: Column, halls: dict | None = None) -> Column:
    """Hall whose keywords occur most, from the configured keyword lists."""
    return convo_room(content, None, halls or fixed.HALL_KEYWORDS)


# --- rooms of files ------------------------------------------------------------------------


def detect_room(
    path: Column, content: Column, rooms: list[dict], window: int | None = None,
) -> Column:
    """Room of a file: by folder, then file name, then keyword count, else 'general'.

    ``path`` is relative to the project; ``rooms`` is the project's room list
    ({name, keywords}), a few entries of configuration.
    """
    rooms = [
        {"name": r["name"], "keywords": [k for k in (r.get("keywords") or []) if k]} for r in rooms if r.get("name")
    ]
    if not rooms:
        return F.lit("general")
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    folders = F.split(low, "/", -1)
    folders = F.slice(folders, 1, F.size(folders) - 1)
    name = F.lower(tx.stem(path))
    text = F.lower(content if window is None else F.left(content, F.lit(window)))

    def overlaps(a: Column, b: str) -> Column:
        return F.contains(a, F.lit(b)) | F.contains(F.lit(b), a)

    def room_of(part: Column) -> Column:
        return F.coalesce(*[
            F.when(sum_or([overlaps(part, w.lower()) for w in [r["name"], *r["keywords"]]]), F.lit(r["name"])) for r in rooms
        ])

    by_folder = F.get(F.filter(F.transform(folders, room_of), lambda r: r.isNotNull()), F.lit(0))
    by_name = F.coalesce(*[F.when(overlaps(name, r["name"].lower()), F.lit(r["name"])) for r in rooms])
    scores = [
        (r["name"], sum((tx.count_substring(text, F.lit(k.lower())) for k in [*r["keywords"], r["name"]]), F.lit(0)))
        for r in rooms
    ]
    return F.coalesce(by_folder, by_name, _first_best(scores), F.lit("general"))


def sum_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _folder_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in fixed.FOLDER_ROOMS.items() for x in kv])


def rooms_from_folders(dirs: DataFrame) -> DataFrame:
    """Rooms of projects from their folders: (project, name, description, keywords).

    ``dirs`` has (project, path) with paths relative to the project.  Top
    folders count by the folder table or under their own name; folders one
    level down only by the table.  Every project also gets 'general'.
    """
    skip = list(fixed.ROOM_SKIP_DIRS)
    parts = F.split("path", "/")
    rows = dirs.select("project", "path", F.size(parts).alias("depth"), F.element_at(parts, -1).alias("dir"), F.get(parts, F.lit(0)).alias("top"))
    rows = rows.where((F.col("depth") <= 2) & ~F.col("dir").isin(skip) & ~F.col("top").isin(skip)).distinct()
    key = F.replace(F.lower("dir"), F.lit("-"), F.lit("_"))
    known = F.try_element_at(_folder_map(), key)
    own = F.when(
        (F.col("depth") == 1) & (F.length("dir") > 2) & F.rlike("dir", F.lit("^[a-zA-Z]")), F.replace(key, F.lit(" "), F.lit("_"))
    )
    named = rows.withColumn("name", F.coalesce(known, own)).where(F.col("name").isNotNull())
    first = named.groupBy("project", "name").agg(F.min_by("dir", F.struct("depth", "path")).alias("dir"))
    found = first.select(
        "project", "name", F.concat(F.lit("Files from "), F.col("dir"), F.lit("/")).alias("description"),
        F.array("name", F.lower("dir")).alias("keywords"),
    )
    rest = dirs.select("project").distinct().join(found.where(F.col("name") == "general").select("project"), "project", "left_anti")
    return found.unionByName(rest.select(
        "project", F.lit("general").alias("name"), F.lit("Files that don't fit other rooms").alias("description"),
        F.array().cast("array<string>").alias("keywords"),
    ))


def rooms_from_files(files: DataFrame, top: int | None = None) -> DataFrame:
    """Rooms of projects from recurring words in file names: at least two files; all, or the best few."""
    skip = list(fixed.FILE_ROOM_SKIP_DIRS)
    parts = F.split("path", "/")
    usable = files.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(s) for s in skip])))
    name = F.regexp_replace(F.lower(tx.basename(F.col("path"))), "[- ]", "_")
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("room"), F.lit(i).alias("ord")) for i, (k, v) in enumerate(fixed.FOLDER_ROOMS.items())])
    hits = usable.select("project", F.explode(F.filter(entries, lambda e: F.contains(name, e["k"]))).alias("e"))
    counted = hits.groupBy("project", F.col("e.room").alias("name")).agg(F.count("*").alias("n"), F.min("e.ord").alias("ord"))
    order = Window.partitionBy("project").orderBy(F.desc("n"), "ord")
    best = counted.where(F.col("n") >= 2)
    if top is not None:
        best = best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    found = best.select(
        "project", "name", F.concat(F.lit("Files related to "), F.col("name")).alias("description"), F.array("name").alias("keywords"), "n",
    )
    rest = files.select("project").distinct().join(found.select("project").distinct(), "project", "left_anti")
    return found.unionByName(rest.select(
        "project", F.lit("general").alias("name"), F.lit("All project files").alias("description"),
        F.array().cast("array<string>").alias("keywords"), F.lit(0).cast("bigint").alias("n"),
    ))


def detect_rooms(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Rooms per project: from folders, or from file names where folders say nothing."""
    by_folder = rooms_from_folders(dirs)
    useful = by_folder.groupBy("project").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("project")
    projects = files.select("project").union(dirs.select("project")).distinct()
    rest = files.join(useful, "project", "left_anti")
    flat = projects.join(useful, "project", "left_anti").join(files.select("project").distinct(), "project", "left_anti")
    general = flat.select(
        "project", F.lit("general").alias("name"), F.lit("All project files").alias("description"),
        F.array().cast("array<string>").alias("keywords"), F.lit("fallback (flat project)").alias("source"),
    )
    return (
        by_folder.join(useful, "project", "left_semi").withColumn("source", F.lit("folder structure"))
        .unionByName(rooms_from_files(rest).drop("n").withColumn("source", F.lit("filename patterns")))
        .unionByName(general)
    )


# --- memory types ----------------------------------------------------------------------------


def is_code_line(line: Column) -> Column:
    """Shell, code, table or mostly symbolic lines."""
    return _is_code(tx.strip(line))


_LETTERS = string.ascii_letters


def _is_code(trimmed: Column) -> Column:
    # Letters are the characters that taking them out leaves less.
    letters = F.length(trimmed) - F.length(F.translate(trimmed, _LETTERS, ""))
    mostly_symbols = (F.length(trimmed) > 10) & (letters < F.length(trimmed) * 0.4)
    return (trimmed != "") & (tx.matches_any(trimmed, fixed.CODE_LINE_PATTERNS) | mostly_symbols)


def prose(text: Column) -> Column:
    """The text without fenced blocks and code lines; all of it if nothing is left."""

    def without_code(lines: Column) -> Column:
        # A line is trimmed once and looked at several times.
        both = F.transform(lines, lambda x: F.struct(x.alias("line"), tx.strip(x).alias("trimmed")))
        return F.array_join(F.transform(F.filter(both, lambda x: ~_is_code(x["trimmed"])), lambda x: x["line"]), "\n")

    # Pieces at odd positions between fence lines are code.
    blocks = F.split(F.concat(F.lit("\n"), text), r"\n[^\S\n]*```[^\n]*", -1)
    open_blocks = F.filter(blocks, lambda b, i: i % 2 == 0)
    kept = F.transform(open_blocks, lambda b: without_code(F.split(F.substring(b, 2, 1 << 30), "\n", -1)))
    fenced = F.array_join(F.filter(kept, lambda b: b != ""), "\n")
    left = F.when(F.contains(text, F.lit("```")), fenced).otherwise(without_code(F.split(text, "\n", -1)))
    # Trimmed once, in a list of one.
    joined = F.filter(F.array(tx.strip(left)), lambda x: x != "")
    return F.coalesce(F.get(joined, F.lit(0)), text)


def _is_turn(line: Column) -> Column:
    return tx.matches_any(tx.strip(line), fixed.TURN_PATTERNS)


def with_segments(docs: DataFrame, text: str) -> DataFrame:
    """Rows with _segs: speaker turns if there are three, else paragraphs, else 25-line groups."""
    # Each step is worked out once; a text without any sign of a turn is not looked at line by line.
    signs = [tx.required_text(p) for p in fixed.TURN_PATTERNS]
    may_turn = sum_or([F.contains(F.col(text), F.lit(s)) for s in signs]) if all(signs) else F.lit(True)
    docs = tx.computed(docs, {"_lines": tx.lines_of(F.col(text)), "_paras": tx.paragraphs(F.col(text))})
    lines = F.col("_lines")
    flags = F.when(may_turn, F.transform(lines, _is_turn)).otherwise(F.array().cast("array<boolean>"))
    docs = tx.computed(docs, {"_turns": flags})
    starts = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | F.element_at("_turns", i + 1)
    )
    by_turn = F.transform(
        F.transform(starts, lambda s, j: F.struct(s.alias("at"), F.coalesce(F.get(starts, j + 1), F.size(lines)).alias("end"))),
        lambda s: F.array_join(F.slice(lines, s["at"] + 1, s["end"] - s["at"]), "\n"),
    )
    groups = F.filter(tx.line_groups(lines, fixed.LINE_GROUP), lambda g: g != "")
    one_block = (F.size("_paras") <= 1) & (F.size(lines) > fixed.LINE_GROUP_THRESHOLD)
    turns = F.size(F.filter("_turns", lambda t: t))
    segs = F.when(turns >= 3, by_turn).when(one_block, groups).otherwise(F.col("_paras"))
    return docs.withColumn("_segs", segs).drop("_lines", "_paras", "_turns")


def marker_scores(text: Column, markers: dict | None = None) -> dict[str, Column]:
    low = F.lower(text)
    return {kind: tx.regexp_hits(low, patterns) for kind, patterns in (markers or fixed.MEMORY_MARKERS).items()}


def sentiment(text: Column) -> Column:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))
    good = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in fixed.POSITIVE_WORDS])))
    bad = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in fixed.NEGATIVE_WORDS])))
    return F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")


def has_resolution(text: Column) -> Column:
    return tx.matches_any(F.lower(text), fixed.RESOLUTION_PATTERNS)


def problem_type(scores: dict[str, Column], mood: Column, resolved: Column) -> Column:
    """What a problem really is: solved or happily told ones are something else."""
    happy = mood == "positive"
    moving, done = scores["emotional"] > 0, scores["milestone"] > 0
    return (
        F.when(resolved & moving & happy, "emotional").when(resolved, "milestone")
        .when(happy & done, "milestone").when(happy & moving, "emotional").otherwise("problem")
    )


def memory_confidence(best_score: Column, length: Column) -> Column:
    bonus = F.when(length > 500, 2).when(length > 200, 1).otherwise(0)
    return F.least(F.lit(1.0), (best_score + bonus) / 5.0)


def extract_memories(docs: DataFrame, text: str = "document", key: str = "original_id", min_confidence: float = 0.3) -> DataFrame:
    """Typed memories of texts: (key, chunk_index, content, memory_type, confidence, scores).

    Segments are scored in their own rows; only the numbering of kept ones
    looks at a document's rows together.
    """
    rest = [c for c in docs.columns if c != text]
    segs = with_segments(docs, text).select(*rest, F.posexplode("_segs").alias("_pos", "_seg"))
    segs = tx.computed(segs.where(F.length(tx.strip(F.col("_seg"))) >= 20), {"_prose": prose(F.col("_seg"))})
    segs = tx.computed(segs, {"_low": F.lower("_prose")})
    scored = tx.computed(segs, {f"{k}_score": tx.regexp_hits(F.col("_low"), p) for k, p in fixed.MEMORY_MARKERS.items()})
    scores = {k: F.col(f"{k}_score") for k in fixed.MEMORY_MARKERS}
    top = F.greatest(*scores.values())
    hits = scored.where(top > 0).withColumn("confidence", memory_confidence(top, F.length("_seg"))).where(
        F.col("confidence") >= min_confidence
    )
    # Mood and solution are only asked of problems, and once.
    hits = tx.computed(hits, {"_best": _first_best(list(scores.items()))})
    asked = F.col("_best") == "problem"
    hits = tx.computed(hits, {"_mood": F.when(asked, sentiment(F.col("_prose"))), "_solved": F.when(asked, has_resolution(F.col("_prose")))})
    typed = hits.withColumn("memory_type", F.when(asked, problem_type(scores, F.col("_mood"), F.col("_solved"))).otherwise(F.col("_best")))
    # A document's segments come from one row, so this window is never larger than that row.
    order = Window.partitionBy(key).orderBy("_pos")
    return typed.select(
        *rest, (F.row_number().over(order) - 1).alias("chunk_index"), tx.strip(F.col("_seg")).alias("content"),
        "memory_type", "confidence", *[f"{k}_score" for k in fixed.MEMORY_MARKERS],
    )
