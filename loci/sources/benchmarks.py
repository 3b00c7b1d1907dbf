"""Loaders of four public question sets about long conversations, each as flat tables.

Every loader starts from a column of JSON text, so the files may be read whole, as JSON
lines, or come from a table.  ``read`` gives one row per entry of a file or folder.  From the
entries come
  corpus    (corpus_id, content, owner, ord): what can be retrieved; the first text of an id counts
  questions (question_id, owner, category, question, answer)
  evidence  (question_id, corpus_id) or (question_id, text)
``owner`` is the entry a text or question belongs to, so that a search can keep to it.
``ord`` puts texts in the order of the entries and inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MEMORY = (
    "struct<question_id: string, question_type: string, question: string, answer: string, question_date: string, haystack_session_ids: array<string>, "
    "haystack_dates: array<string>, haystack_sessions: array<array<struct<role: string, content: string>>>, answer_session_ids: array<string>>"
)
# Sessions stand under keys of their own (session_1, session_2, ...), so the conversation is read as a map of JSON texts.
LONG_TALK = (
    "struct<sample_id: string, conversation: map<string, string>, session_summary: map<string, string>, "
    "qa: array<struct<question: string, answer: string, adversarial_answer: string, evidence: array<string>, category: int>>>"
)
DIALOGS = "array<struct<speaker: string, dia_id: string, text: string>>"
EVIDENCE_ITEMS = (
    "struct<evidence_items: array<struct<question: string, answer: string, message_evidences: array<struct<speaker: string, text: string>>, "
    "conversations: array<struct<messages: array<struct<speaker: string, text: string>>>>>>>"
)
STEPS = (
    "map<string, array<struct<tid: string, message_list: array<string>, "
    "QA: struct<question: string, choices: map<string, string>, ground_truth: string, answer: string, target_step_id: array<string>>>>>"
)
STEP = "user string, user_message string, assistant string, assistant_message string, time string"
TALK_CATEGORIES = {1: "Single-hop", 2: "Temporal", 3: "Temporal-inference", 4: "Open-domain", 5: "Adversarial"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, json): each file's text, or each object of a top-level array as a text of its own, in file order."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("*", F.col("_metadata.file_path").alias("path"))
    return entries(whole.select("path", F.col("value").alias("json")))


def entries(texts: DataFrame) -> DataFrame:
    """(path, at, json) of texts (path, json); a top-level array becomes a row per object.  Broken JSON gives no row."""
    listed = F.when(F.ltrim("json").startswith("["), F.from_json("json", "array<string>")).otherwise(F.array("json"))
    return texts.select("path", F.posexplode(listed).alias("at", "json"))


def _filled(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _first_texts(rows: DataFrame, own: bool) -> DataFrame:
    """The first text of every id (with ``own``: of every id of an entry), unless that is blank."""
    first = rows.groupBy("corpus_id", *(["owner"] if own else [])).agg(F.min_by(F.struct("content", F.col("owner").alias("from"), "ord"), "ord").alias("f"))
    return first.select("corpus_id", "f.content", F.col("f.from").alias("owner"), "f.ord").where(F.btrim(F.coalesce("content", F.lit(""))) != "")


class LongMemory:
    """Questions over a haystack of dated sessions (a JSON array of entries)."""

    def __init__(self, rows: DataFrame):
        self.entries = rows.select("path", "at", F.from_json("json", LONG_MEMORY).alias("e")).select("path", "at", "e.*").where(F.col("question_id").isNotNull())

    def turns(self) -> DataFrame:
        """One row per (question, session, turn)."""
        sessions = self._sessions()
        return sessions.select("question_id", "session_id", "session_no", "date", F.posexplode("turns").alias("turn_no", "t")).select(
            "question_id", "session_id", "session_no", "date", "turn_no", "t.role", "t.content")

    def _sessions(self) -> DataFrame:
        zipped = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.coalesce("haystack_dates", F.array()).alias("date"), F.col("haystack_sessions").alias("turns"))
        return self.entries.select("path", "at", "question_id", F.posexplode(zipped).alias("session_no", "s")).select(
            "path", "at", "question_id", "session_no", F.col("s.id").alias("session_id"), F.col("s.date").alias("date"), F.col("s.turns").alias("turns"))

    def corpus(self, granularity: str = "session", own: bool = False) -> DataFrame:
        """What the user said, per session or per turn."""
        sessions = self._sessions().withColumn("own", F.filter("turns", lambda t: t["role"] == "user"))
        order = [F.col(c) for c in ("path", "at", "session_no")]
        if granularity == "session":
            text = F.array_join(F.transform("own", lambda t: F.coalesce(t["content"], F.lit(""))), "\n")
            rows = sessions.select(F.col("session_id").alias("corpus_id"), text.alias("content"), F.col("question_id").alias("owner"), F.struct(*order, F.lit(0).alias("turn")).alias("ord"))
        else:
            said = sessions.select("*", F.posexplode("own").alias("turn", "t"))
            name = F.concat("session_id", F.lit("_turn_"), F.col("turn").cast("string"))
            rows = said.select(name.alias("corpus_id"), F.col("t.content").alias("content"), F.col("question_id").alias("owner"), F.struct(*order, "turn").alias("ord"))
        return _first_texts(rows, own)

    def haystacks(self) -> DataFrame:
        """(question_id, corpus_id) of the sessions each question may search."""
        return self._sessions().select("question_id", F.col("session_id").alias("corpus_id")).distinct()

    def questions(self) -> DataFrame:
        return self.entries.select("question_id", F.col("question_id").alias("owner"), F.col("question_type").alias("category"), "question", "answer", "question_date")

    def evidence(self) -> DataFrame:
        """(question_id, corpus_id): sessions with the answer; a turn's id begins with its session's."""
        return self.entries.select("question_id", F.explode("answer_session_ids").alias("corpus_id")).distinct()


class LongTalk:
    """Questions over conversations of numbered sessions (a JSON array of samples)."""

    def __init__(self, rows: DataFrame):
        self.entries = rows.select("path", "at", F.from_json("json", LONG_TALK).alias("e")).select("path", "at", "e.*").where(F.col("conversation").isNotNull())

    def dialogs(self) -> DataFrame:
        """One row per (sample, session, dialog); sessions count from 1 up to the first number that is missing."""
        numbers = F.transform(F.filter(F.map_keys("conversation"), lambda k: F.rlike(k, F.lit(r"^session_[0-9]+$"))), lambda k: F.substring(k, 9, 20).cast("int"))
        in_row = F.filter(F.transform(F.array_sort(F.filter(numbers, lambda n: n > 0)), lambda n, i: F.when(n == i + 1, n)), lambda n: n.isNotNull())
        sessions = self.entries.select("path", "at", "sample_id", "conversation", "session_summary", F.explode(in_row).alias("session_no"))
        key = F.concat(F.lit("session_"), F.col("session_no").cast("string"))
        held = sessions.select(
            "path", "at", "sample_id", "session_no", F.coalesce(F.try_element_at("conversation", F.concat(key, F.lit("_date_time"))), F.lit("")).alias("date"),
            F.coalesce(F.try_element_at("session_summary", F.concat(key, F.lit("_summary"))), F.lit("")).alias("summary"),
            F.from_json(F.try_element_at("conversation", key), DIALOGS).alias("dialogs"))
        return held.select("*", F.posexplode("dialogs").alias("dialog_no", "d")).select(
            "path", "at", "sample_id", "session_no", "date", "summary", "dialog_no", "d.speaker", "d.dia_id", "d.text")

    def corpus(self, granularity: str = "session", own: bool = False) -> DataFrame:
        line = F.concat(_filled(F.col("speaker"), "?"), F.lit(' said, "'), F.coalesce("text", F.lit("")), F.lit('"'))
        rows = self.dialogs().withColumn("line", line)
        if granularity == "session":
            lines = F.transform(F.array_sort(F.collect_list(F.struct("dialog_no", "line"))), lambda x: x["line"])
            held = rows.groupBy("path", "at", "sample_id", "session_no").agg(F.array_join(lines, "\n").alias("content"))
            named = held.select(F.concat(F.lit("session_"), F.col("session_no").cast("string")).alias("corpus_id"), "content", F.col("sample_id").alias("owner"),
                                F.struct("path", "at", "session_no", F.lit(0).alias("dialog_no")).alias("ord"))
        else:
            name = F.coalesce(F.nullif("dia_id", F.lit("")), F.concat(F.lit("D"), F.col("session_no").cast("string"), F.lit(":?")))
            named = rows.select(name.alias("corpus_id"), F.col("line").alias("content"), F.col("sample_id").alias("owner"), F.struct("path", "at", "session_no", "dialog_no").alias("ord"))
        return _first_texts(named, own)

    def _asked(self) -> DataFrame:
        return self.entries.select("path", "at", "sample_id", F.posexplode("qa").alias("no", "q")).withColumn(
            "question_id", F.concat_ws("/", _filled(F.col("sample_id"), "unknown"), F.col("no").cast("string")))

    def questions(self) -> DataFrame:
        names = F.create_map(*[F.lit(x) for pair in TALK_CATEGORIES.items() for x in pair])
        known = F.coalesce(F.try_element_at(names, F.col("q.category")), F.concat(F.lit("Cat-"), F.col("q.category").cast("string")))
        return self._asked().select("question_id", F.col("sample_id").alias("owner"), known.alias("category"), "q.question",
                                    F.coalesce(F.nullif("q.answer", F.lit("")), F.col("q.adversarial_answer")).alias("answer"))

    def evidence(self, granularity: str = "session") -> DataFrame:
        from loci.operators.evaluate import session_of

        rows = self._asked().select("question_id", F.explode("q.evidence").alias("corpus_id"))
        return rows.select("question_id", (session_of(F.col("corpus_id")) if granularity == "session" else F.col("corpus_id")).alias("corpus_id")).distinct()


class EvidenceTalk:
    """Questions with the messages that answer them; files stand in a folder per category."""

    def __init__(self, rows: DataFrame):
        category = F.element_at(F.split("path", "/"), -2)
        self.items = rows.select("path", "at", F.when(F.contains("path", F.lit("/")), category).alias("category"), F.posexplode(F.from_json("json", EVIDENCE_ITEMS)["evidence_items"]).alias("no", "i")).withColumn(
            "item", F.concat_ws("/", "path", F.col("at").cast("string"), F.col("no").cast("string")))

    def corpus(self, own: bool = False) -> DataFrame:
        """Messages as "speaker: text", each text once, the first one."""
        talks = self.items.select("item", "path", "at", "no", F.posexplode("i.conversations").alias("talk", "c"))
        rows = talks.select("item", "path", "at", "no", "talk", F.posexplode("c.messages").alias("message", "m"))
        text = F.btrim(F.coalesce("m.text", F.lit("")), F.lit(" \t\n\r"))
        said = rows.where(text != "").select(
            F.concat_ws("_", "item", F.concat(F.lit("conv"), F.col("talk").cast("string")), F.concat(F.lit("msg"), F.col("message").cast("string"))).alias("corpus_id"),
            F.concat(_filled(F.col("m.speaker"), "Unknown"), F.lit(": "), text).alias("content"), F.col("item").alias("owner"), F.struct("path", "at", "no", "talk", "message").alias("ord"))
        once = said.groupBy("content", *(["owner"] if own else [])).agg(F.min_by(F.struct("corpus_id", F.col("owner").alias("from"), "ord"), "ord").alias("f"))
        return once.select("f.corpus_id", "content", F.col("f.from").alias("owner"), "f.ord")

    def questions(self) -> DataFrame:
        return self.items.select(F.col("item").alias("question_id"), F.col("item").alias("owner"), "category", "i.question", "i.answer")

    def evidence(self) -> DataFrame:
        return self.items.select(F.col("item").alias("question_id"), F.explode("i.message_evidences").alias("e")).select("question_id", F.coalesce("e.text", F.lit("")).alias("text")).distinct()


class StepTalk:
    """Multiple-choice questions over numbered steps (a file per category, topics as keys).

    A long file may come in pieces, which are files of the same path and entry with some of the items: ``first``, if
    there is such a column, says how many items of its topics stand in the pieces before.
    """

    def __init__(self, rows: DataFrame, topic: str | None = None):
        category = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
        self.entries = rows
        first = F.col("first") if "first" in rows.columns else F.lit(0)
        topics = rows.select(category.alias("category"), "path", "at", first.alias("first"), F.explode(F.from_json("json", STEPS)).alias("topic", "items"))
        if topic:
            topics = topics.where(F.col("topic").isin(topic, "roles", "events"))
        each = topics.select("category", "path", "at", "topic", "first", F.posexplode("items").alias("no", "i"))
        each = each.withColumn("no", F.col("no") + F.col("first")).drop("first")
        usable = each.where((F.size("i.message_list") > 0) & F.col("i.QA").isNotNull())
        self.items = usable.withColumn("item", F.concat_ws("_", "category", F.coalesce("i.tid", F.lit("0"))))

    def steps(self) -> DataFrame:
        """One row per (item, step); lists of lists are taken one after the other.  Steps that are no objects keep their number and have no text."""
        flat = F.flatten(F.transform("i.message_list", lambda m: F.when(F.ltrim(m).startswith("["), F.from_json(m, "array<string>")).otherwise(F.array(m))))
        rows = self.items.select("item", "category", "path", "at", "topic", "no", F.posexplode(flat).alias("step", "m"))
        return rows.withColumn("t", F.when(F.ltrim("m").startswith("{"), F.from_json("m", STEP))).drop("m")

    def corpus(self, own: bool = False) -> DataFrame:
        user = F.coalesce(F.nullif("t.user", F.lit("")), F.col("t.user_message"), F.lit(""))
        helper = F.coalesce(F.nullif("t.assistant", F.lit("")), F.col("t.assistant_message"), F.lit(""))
        time = F.when(F.coalesce("t.time", F.lit("")) != "", F.concat(F.lit("["), F.col("t.time"), F.lit("] "))).otherwise("")
        text = F.concat(time, F.lit("[User] "), user, F.lit(" [Assistant] "), helper)
        rows = self.steps().where(F.col("t").isNotNull()).select(
            F.concat("item", F.lit("_step_"), F.col("step").cast("string")).alias("corpus_id"), text.alias("content"), F.col("item").alias("owner"),
            F.struct("path", "at", "topic", "no", "step").alias("ord"))
        return _first_texts(rows, own)

    def questions(self) -> DataFrame:
        name = F.concat_ws("/", "item", "topic", F.col("no").cast("string"))
        return self.items.select(name.alias("question_id"), F.col("item").alias("owner"), "category", F.coalesce("i.QA.question", F.lit("")).alias("question"),
                                 F.coalesce("i.QA.answer", F.lit("")).alias("answer"), F.col("i.QA.choices").alias("choices"),
                                 F.upper(F.coalesce("i.QA.ground_truth", F.lit(""))).alias("ground_truth"))

    def evidence(self) -> DataFrame:
        name = F.concat_ws("/", "item", "topic", F.col("no").cast("string"))
        return self.items.select(name.alias("question_id"), "item", F.explode("i.QA.target_step_id").alias("s")).select(
            "question_id", F.concat("item", F.lit("_step_"), F.col("s")).alias("corpus_id")).distinct()
