"""Conversations as message rows, and files that hold several sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.operators.skew import neighbours, running_count


# --- message rows -------------------------------------------------------------------------


def pair_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Transcript blocks: a user message with the assistant message right after it.

    ``messages`` has (conv, turn, role, content); other roles are dropped
    first.  An assistant message not answering a user one is a block of its
    own.  Works in segments, so one endless conversation is no obstacle.
    """
    kept = messages.where(F.col("role").isin("user", "assistant"))
    seen = neighbours(
        kept, [conv], turn, {"_next": F.struct("role", "content")}, {"_prev": F.col("role")}
    )
    answered = (F.col("role") == "user") & (F.col("_next.role") == "assistant")
    taken = (F.col("role") == "assistant") & F.coalesce(F.col("_prev") == "user", F.lit(False))
    return seen.where(~taken).select(
        conv, turn,
        F.when(F.col("role") == "user", F.col("content")).alias("user_text"),
        F.when(F.col("role") == "assistant", F.col("content")).when(answered, F.col("_next.content")).alias("assistant_text"),
    )


def transcript_block(user_text: Column, assistant_text: Column) -> Column:
    """A block in transcript form: `> ` before the user's words."""
    return F.concat_ws("\n", F.concat(F.lit("> "), user_text), assistant_text)


def number_blocks(blocks: DataFrame, conv: str = "conv_id", turn: str = "turn", least: int = fixed.EXCHANGE_MIN) -> DataFrame:
    """Blocks long enough to keep, numbered per conversation from 0."""
    content = transcript_block(F.col("user_text"), F.col("assistant_text"))
    kept = blocks.withColumn("content", content).where(F.length(tx.strip(F.col("content"))) > least)
    return running_count(kept, [conv], turn, F.lit(True), "_n").select(
        conv, turn, (F.col("_n") - 1).alias("chunk_index"), "content"
    )


# --- several sessions in one file ------------------------------------------------------------


def session_starts(lines: Column) -> Column:
    """Positions of header lines that are not followed by a restore notice."""

    def starts(i: Column) -> Column:
        near = F.slice(lines, i + 1, F.lit(6))
        restored = F.exists(near, lambda x: F.contains(x, F.lit(fixed.RESTORE_MARKERS[0])) | F.contains(x, F.lit(fixed.RESTORE_MARKERS[1])))
        return F.contains(F.element_at(lines, i + 1), F.lit(fixed.SESSION_HEADER)) & ~restored

    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), starts)


def session_timestamp(lines: Column, head: int | None = None) -> Column:
    """struct<human, iso> of the first timestamp, in all lines or the first ``head``."""
    head = F.filter(lines if head is None else F.slice(lines, 1, head), lambda x: F.rlike(x, F.lit(fixed.TIMESTAMP_PATTERN)))
    first = F.get(head, F.lit(0))

    def group(n):
        return F.regexp_extract(first, fixed.TIMESTAMP_PATTERN, n)

    months = F.array(*[F.lit(m) for m in fixed.MONTHS])
    month = F.lpad(F.array_position(months, group(2)).cast("string"), 2, "0")
    iso = F.concat_ws("-", group(4), month, F.lpad(group(3), 2, "0"))
    human = F.concat(iso, F.lit("_"), F.regexp_replace(group(1), "[: ]", ""))
    return F.when(first.isNotNull(), F.struct(human.alias("human"), iso.alias("iso")))


def session_people(lines: Column, known=fixed.KNOWN_PEOPLE, usernames: dict[str, str] | None = None, head: int | None = None) -> Column:
    """Sorted known names in all lines or the first ``head``, plus the user-folder owner."""
    head = F.array_join(lines if head is None else F.slice(lines, 1, head), "\n")
    hits = [F.when(F.rlike(head, F.lit("(?i)" + tx.java_pattern(rf"\b{n}\b"))), F.lit(n)) for n in known]
    owner = F.regexp_extract(head, r"/Users/(\w+)/", 1)
    for user, name in (usernames or {}).items():
        hits.append(F.when(owner == user, F.lit(name)))
    return F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def session_subject(lines: Column) -> Column:
    """First real prompt, safe for a file name, at most sixty characters."""
    prompts = F.transform(F.filter(lines, lambda x: x.startswith("> ")), lambda x: tx.strip(F.substring(x, 3, 1 << 30)))
    real = F.filter(prompts, lambda p: (F.length(p) > 5) & ~F.rlike(p, F.lit(fixed.SHELL_PROMPTS)))
    first = F.get(real, F.lit(0))
    clean = F.regexp_replace(first, r"[^A-Za-z0-9_\s-]", "")
    clean = F.left(F.regexp_replace(tx.strip(clean), r"\s+", "-"), F.lit(60))
    return F.coalesce(clean, F.lit("session"))


def split_sessions(files: DataFrame, known=fixed.KNOWN_PEOPLE, usernames=None, min_sessions: int = 2, min_lines: int = 1) -> DataFrame:
    """One row per session of files (path, content) that hold at least two.

    Text before the first session is no session.  ``min_lines`` leaves short
    ones out (fixed.SESSION_MIN_LINES is usual); they still count for the part number.
    """
    lines = F.split(F.col("content"), "(?<=\n)", -1)
    lines = F.filter(lines, lambda x: x != "")
    found = tx.computed(files, {"_lines": lines})
    found = tx.computed(found, {"_at": session_starts(F.col("_lines"))}).where(F.size("_at") >= min_sessions)
    spans = F.transform(
        F.col("_at"),
        lambda s, i: F.struct(
            (i + 1).alias("part"), s.alias("start"),
            F.coalesce(F.get(F.col("_at"), i + 1), F.size("_lines")).alias("stop"),
        ),
    )
    parts = found.withColumn("_s", F.explode(spans)).where(
        F.col("_s.stop") - F.col("_s.start") >= min_lines
    ).withColumn("_chunk", F.slice("_lines", F.col("_s.start") + 1, F.col("_s.stop") - F.col("_s.start"))).drop("_lines", "_at")
    people = session_people(F.col("_chunk"), known, usernames)
    stamp = session_timestamp(F.col("_chunk"))
    named = parts.withColumns({"_people": people, "_stamp": stamp, "subject": session_subject(F.col("_chunk"))})
    source = F.left(F.regexp_replace(tx.stem(F.col("path")), r"[^A-Za-z0-9_-]", "_"), F.lit(40))
    when = F.coalesce(F.col("_stamp.human"), F.concat(F.lit("part"), F.lpad(F.col("_s.part").cast("string"), 2, "0")))
    who = F.when(F.size("_people") > 0, F.array_join(F.slice("_people", 1, 3), "-")).otherwise("unknown")
    name = F.concat(source, F.lit("__"), when, F.lit("_"), who, F.lit("_"), F.col("subject"), F.lit(".txt"))
    name = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_"), "_+", "_")
    return named.select(
        "path", F.col("_s.part").alias("part"), F.col("_s.start").alias("first_line"),
        F.size("_chunk").alias("line_count"), F.col("_stamp.human").alias("timestamp"), F.col("_stamp.iso").alias("date"),
        F.col("_people").alias("people"), "subject", name.alias("file_name"), F.array_join("_chunk", "").alias("content"),
    )
