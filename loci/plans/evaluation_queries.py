"""Question sets nested out of the conversations, and the evaluations over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.operators import evaluate
from loci.operators.skew import running_count
from loci.plans.catalog import query
from loci.plans.retrieval_queries import hashed_sql
from loci.plans.workload import Tables
from loci.session import kept
from loci.sources import benchmarks

# --- the conversations as entries of each set -------------------------------------------------------------


def _talks(t: Tables) -> DataFrame:
    """(conv_id, turns): an array of (turn, role, content) in order."""
    rows = t.conversations.select("conv_id", F.struct("turn", "role", F.col("text").alias("content")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _entry(path, at, json) -> list:
    return [path.alias("path"), at.cast("int").alias("at"), json.alias("json")]


def long_memory(t: Tables) -> benchmarks.LongMemory:
    """Entries of five conversations and the first of the next five; the question is what the user said first in one of them."""
    talks = _talks(t)
    own, shared = F.floor(F.col("conv_id") / 5), F.when((F.col("conv_id") % 5 == 0) & (F.col("conv_id") > 0), F.floor(F.col("conv_id") / 5) - 1)
    dealt = talks.withColumn("g", F.explode(F.array_compact(F.array(own, shared))))
    session = F.struct("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
    asked = F.when(F.col("conv_id") == F.col("g") * 5 + F.col("g") % 5, F.get(F.filter("turns", lambda x: x["role"] == "user"), F.lit(0))["content"])
    grouped = dealt.withColumn("q", asked).groupBy("g").agg(F.array_sort(F.collect_list(session)).alias("s"), F.max("q").alias("question"))
    answer = F.concat(F.lit("conv_"), (F.col("g") * 5 + F.col("g") % 5).cast("string"))
    rows = grouped.select(*_entry(F.lit("x"), F.col("g"), F.to_json(F.struct(
        F.concat(F.lit("q"), F.col("g").cast("string")).alias("question_id"), F.concat(F.lit("type"), (F.col("g") % 3).cast("string")).alias("question_type"),
        F.coalesce("question", F.lit("")).alias("question"), F.lit(7).alias("answer"),
        F.transform("s", lambda x: F.concat(F.lit("conv_"), x["conv_id"].cast("string"))).alias("haystack_session_ids"),
        F.transform("s", lambda x: F.concat(F.lit("day "), x["conv_id"].cast("string"))).alias("haystack_dates"),
        F.transform("s", lambda x: x["turns"]).alias("haystack_sessions"),
        F.when(F.col("g") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(answer)).alias("answer_session_ids"),
    ))))
    return benchmarks.LongMemory(rows)


def long_talk(t: Tables) -> benchmarks.LongTalk:
    """Samples of four conversations as sessions 1 to 4; in every fifth sample the third one is numbered 9, which ends the row."""
    talks = _talks(t).withColumns({"g": F.floor(F.col("conv_id") / 4), "r": F.col("conv_id") % 4})
    number = F.when((F.col("g") % 5 == 4) & (F.col("r") == 2), 9).otherwise(F.col("r") + 1).cast("string")
    key = F.concat(F.lit("session_"), number)
    dialogs = F.transform("turns", lambda x: F.struct(
        x["role"].alias("speaker"), F.concat(F.lit("D"), number, F.lit(":"), x["turn"].cast("string")).alias("dia_id"), x["content"].alias("text")))
    pairs = F.array(F.struct(key.alias("k"), F.to_json(dialogs).alias("v")), F.struct(F.concat(key, F.lit("_date_time")).alias("k"), F.to_json(F.array(F.lit("noon"))).alias("v")))
    cut = talks.select("g", "r", F.explode(pairs).alias("p"), F.get("turns", F.lit(0)).alias("first"))
    grouped = cut.groupBy("g").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), F.col("p.k"), F.lit('":'), F.col("p.v"))), ","), F.lit("}")).alias("conversation"),
        F.max(F.when(F.col("r") == 0, F.col("first.content"))).alias("q0"), F.max(F.when(F.col("r") == 1, F.col("first.content"))).alias("q1"))
    qa = F.to_json(F.array(
        F.struct(F.coalesce("q0", F.lit("")).alias("question"), F.lit("yes").alias("answer"), F.array(F.lit("D1:0")).alias("evidence"), (F.col("g") % 7).cast("int").alias("category")),
        F.struct(F.coalesce("q1", F.lit("")).alias("question"), F.lit("").alias("answer"),
                 F.when(F.col("g") % 2 == 1, F.array(F.lit("D2:0"))).otherwise(F.array().cast("array<string>")).alias("evidence"), F.lit(5).alias("category"))))
    text = F.concat(F.lit('{"sample_id":"s'), F.col("g").cast("string"), F.lit('","conversation":'), F.col("conversation"), F.lit(',"qa":'), qa, F.lit("}"))
    return benchmarks.LongTalk(grouped.select(*_entry(F.lit("x"), F.col("g"), text)))


def evidence_talk(t: Tables) -> benchmarks.EvidenceTalk:
    """Items of three conversations; the last message of the first one is the evidence, in two items of three."""
    talks = _talks(t).withColumn("g", F.floor(F.col("conv_id") / 3))
    talk = F.struct("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("speaker"), x["content"].alias("text"))).alias("messages"))
    grouped = talks.groupBy("g").agg(F.array_sort(F.collect_list(talk)).alias("c"))
    first = F.col("c")[0]["messages"]
    evidence = F.when(F.col("g") % 3 < 2, F.array(F.element_at(first, -1))).otherwise(F.array().cast("array<struct<speaker:string,text:string>>"))
    item = F.struct(first[0]["text"].alias("question"), F.lit("x").alias("answer"), evidence.alias("message_evidences"),
                    F.transform("c", lambda x: F.struct(x["messages"].alias("messages"))).alias("conversations"))
    path = F.concat(F.lit("cat"), (F.col("g") % 4).cast("string"), F.lit("/f"), F.col("g").cast("string"), F.lit(".json"))
    return benchmarks.EvidenceTalk(grouped.select(*_entry(path, F.lit(0), F.to_json(F.struct(F.array(item).alias("evidence_items"))))))


def step_talk(t: Tables) -> benchmarks.StepTalk:
    """Three files of two topics; a conversation is an item, its turns are the steps, in every fifth as a list in a list."""
    steps = F.transform("turns", lambda x: F.struct(
        F.when(x["role"] == "user", x["content"]).alias("user"), F.when(x["role"] != "user", x["content"]).alias("assistant_message"), F.concat(F.lit("t"), x["turn"].cast("string")).alias("time")))
    qa = F.struct(F.col("turns")[0]["content"].alias("question"), F.lit("b").alias("ground_truth"), F.array(F.size("turns") - 1).alias("target_step_id"))
    head = F.concat(F.lit('{"tid":'), F.col("conv_id").cast("string"), F.lit(',"message_list":'), F.when(F.col("conv_id") % 5 == 0, F.to_json(F.array(steps))).otherwise(F.to_json(steps)))
    item = F.concat(head, F.when(F.col("conv_id") % 11 != 10, F.concat(F.lit(',"QA":'), F.to_json(qa))).otherwise(""), F.lit("}"))
    rows = _talks(t).where(F.col("conv_id").isNotNull()).select(
        "conv_id", (F.col("conv_id") % 3).alias("f"), F.when(F.col("conv_id") % 2 == 0, "movie").otherwise("roles").alias("topic"), item.alias("item"))
    # A file is as long as a third of the table, so it comes in pieces of an item each, which know their place in its topic.
    places = running_count(rows.select("conv_id", "f", "topic"), ["f", "topic"], "conv_id", F.lit(True), "no").select("conv_id", (F.col("no") - 1).cast("int").alias("first"))
    text = F.concat(F.lit('{"'), F.col("topic"), F.lit('":['), F.col("item"), F.lit("]}"))
    path = F.concat(F.lit("x/c"), F.col("f").cast("string"), F.lit(".json"))
    # Kept like the files they stand for: they are read for the texts, the questions and the evidence.
    return benchmarks.StepTalk(kept(rows.join(places, "conv_id").select(*_entry(path, F.lit(0), text), "first")), "movie")


# --- the same in SQL ---------------------------------------------------------------------------------------


def _hits_sql(k: int, own: bool = False) -> str:
    """CTE ``found`` (question_id, corpus_id, content) from ``corpus`` (corpus_id, content, owner, ord) and ``questions`` (question_id, question, owner)."""
    per = "owner, content" if own else "content"
    item = "corpus_id || chr(1) || owner" if own else "corpus_id"
    return f"""
filed AS (SELECT {per}, min_by(corpus_id, ord) AS corpus_id FROM corpus WHERE trim(content) <> '' GROUP BY {per}),
items AS (SELECT *, {item} AS item_id FROM filed),
{hashed_sql('ec', 'SELECT item_id AS id, content AS body FROM items')}, {hashed_sql('eq', 'SELECT question_id AS id, question AS body FROM questions')},
edots AS (SELECT q.id AS question_id, c.id AS item_id, round(sum(q.x * c.x), 9) AS dot FROM eq_vec q JOIN ec_vec c USING (b) GROUP BY 1, 2),
found AS (SELECT q.question_id, i.corpus_id, i.content FROM questions q JOIN items i ON {'i.owner = q.owner' if own else 'true'} LEFT JOIN edots d ON d.question_id = q.question_id AND d.item_id = i.item_id
          QUALIFY row_number() OVER (PARTITION BY q.question_id ORDER BY coalesce(dot, 0) DESC, i.item_id) <= {k})
""".strip()


def _scored_sql(match: str) -> str:
    return f"""
SELECT question_id, category, CASE WHEN EXISTS (SELECT 1 FROM evidence e WHERE e.question_id = q.question_id)
  THEN EXISTS (SELECT 1 FROM evidence e JOIN found f ON f.question_id = e.question_id WHERE e.question_id = q.question_id AND {match}) END AS recall_hit
FROM questions q
""".strip()


_LONG_MEMORY_SQL = """
sessions AS (
  SELECT conv_id // 5 AS g, conv_id FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
  SELECT conv_id // 5 - 1, conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 0 AND conv_id > 0),
groups AS (SELECT DISTINCT g FROM sessions),
questions AS (
  SELECT 'q' || g AS question_id, 'q' || g AS owner, 'type' || (g % 3) AS category,
         coalesce((SELECT min_by(text, turn) FROM conversations c WHERE c.conv_id = g * 5 + g % 5 AND role = 'user'), '') AS question FROM groups),
evidence AS (SELECT 'q' || g AS question_id, 'conv_' || (g * 5 + g % 5) AS corpus_id FROM groups WHERE g % 4 <> 3)
""".strip()


@query("long_memory_turns", f"""
WITH {_LONG_MEMORY_SQL},
numbered AS (SELECT g, conv_id, row_number() OVER (PARTITION BY g ORDER BY conv_id) - 1 AS session_no FROM sessions)
SELECT 'q' || g AS question_id, 'conv_' || conv_id AS session_id, session_no, 'day ' || conv_id AS date,
       row_number() OVER (PARTITION BY g, conv_id ORDER BY turn) - 1 AS turn_no, role, text AS content
FROM numbered JOIN conversations USING (conv_id)
""")
def long_memory_turns(t):
    """Every turn of every session of every question's haystack."""
    return long_memory(t).turns()


@query("eval_long_memory", f"""
WITH {_LONG_MEMORY_SQL},
corpus AS (SELECT 'conv_' || conv_id AS corpus_id, string_agg(text, chr(10) ORDER BY turn) AS content, conv_id AS ord FROM conversations WHERE role = 'user' GROUP BY conv_id),
{_hits_sql(3)}
{_scored_sql('e.corpus_id = f.corpus_id')}
""")
def eval_long_memory(t):
    """Sessions found among the best three of all sessions."""
    return evaluate.evaluate_set(long_memory(t), 3, "session").select("question_id", "category", "recall_hit")


@query("eval_long_memory_own", f"""
WITH {_LONG_MEMORY_SQL},
said AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE role = 'user'),
corpus AS (SELECT 'conv_' || conv_id || '_turn_' || n AS corpus_id, text AS content, 'q' || g AS owner, conv_id * 1000 + n AS ord FROM sessions JOIN said USING (conv_id)),
{_hits_sql(2, own=True)}
{_scored_sql('starts_with(f.corpus_id, e.corpus_id)')}
""")
def eval_long_memory_own(t):
    """Turns found among the best two of the question's own haystack."""
    return evaluate.evaluate_set(long_memory(t), 2, "turn", own=True).select("question_id", "category", "recall_hit")


_LONG_TALK_SQL = """
numbered AS (SELECT conv_id // 4 AS g, conv_id % 4 AS r, turn, role, text, CASE WHEN conv_id // 4 % 5 = 4 AND conv_id % 4 = 2 THEN 9 ELSE conv_id % 4 + 1 END AS n FROM conversations),
present AS (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY n) = n AS ok FROM (SELECT DISTINCT g, n FROM numbered)),
dialogs AS (SELECT x.* FROM numbered x JOIN present p ON p.g = x.g AND p.n = x.n AND ok),
firsts AS (SELECT g, r, min_by(text, turn) AS first FROM numbered GROUP BY g, r),
questions AS (
  SELECT 's' || g || '/' || q AS question_id, 's' || g AS owner, coalesce((SELECT first FROM firsts f WHERE f.g = x.g AND f.r = q), '') AS question,
         CASE WHEN q = 1 THEN 'Adversarial' ELSE CASE g % 7 WHEN 1 THEN 'Single-hop' WHEN 2 THEN 'Temporal' WHEN 3 THEN 'Temporal-inference' WHEN 4 THEN 'Open-domain' WHEN 5 THEN 'Adversarial' ELSE 'Cat-' || (g % 7) END END AS category
  FROM (SELECT DISTINCT g FROM numbered) x, (SELECT UNNEST([0, 1]) AS q)),
evidence AS (SELECT 's' || g || '/0' AS question_id, 'D1:0' AS corpus_id FROM firsts UNION SELECT 's' || g || '/1', 'D2:0' FROM firsts WHERE g % 2 = 1),
lines AS (SELECT *, role || ' said, "' || text || '"' AS line FROM dialogs)
""".strip()


@query("eval_long_talk", f"""
WITH {_LONG_TALK_SQL},
corpus AS (SELECT 'session_' || n AS corpus_id, min_by(content, g) AS content, n AS ord FROM (SELECT g, n, string_agg(line, chr(10) ORDER BY turn) AS content FROM lines GROUP BY g, n) GROUP BY n),
{_hits_sql(2)}
{_scored_sql(r"'session_' || regexp_extract(e.corpus_id, '^D(\d+):', 1) = f.corpus_id")}
""")
def eval_long_talk(t):
    """Sessions found among the best two; the first sample with a session number gives its text."""
    return evaluate.evaluate_set(long_talk(t), 2, "session").select("question_id", "category", "recall_hit")


@query("eval_long_talk_own", f"""
WITH {_LONG_TALK_SQL},
corpus AS (SELECT 'D' || n || ':' || turn AS corpus_id, line AS content, 's' || g AS owner, n * 10000 + turn AS ord FROM lines),
{_hits_sql(3, own=True)}
{_scored_sql('e.corpus_id = f.corpus_id')}
""")
def eval_long_talk_own(t):
    """Dialog lines found among the best three of the question's own sample."""
    return evaluate.evaluate_set(long_talk(t), 3, "dialog", own=True).select("question_id", "category", "recall_hit")


@query("eval_evidence_talk", f"""
WITH items AS (SELECT DISTINCT conv_id // 3 AS g FROM conversations),
paths AS (SELECT g, 'cat' || (g % 4) || '/f' || g || '.json' AS path FROM items),
firsts AS (SELECT conv_id // 3 AS g, min(conv_id) AS conv_id FROM conversations GROUP BY 1),
questions AS (SELECT path || '/0/0' AS question_id, 'cat' || (g % 4) AS category, '' AS owner, (SELECT min_by(text, turn) FROM conversations c WHERE c.conv_id = f.conv_id) AS question FROM paths JOIN firsts f USING (g)),
evidence AS (SELECT path || '/0/0' AS question_id, lower((SELECT max_by(text, turn) FROM conversations c WHERE c.conv_id = f.conv_id)) AS text FROM paths JOIN firsts f USING (g) WHERE g % 3 < 2),
placed AS (SELECT *, conv_id // 3 AS g, dense_rank() OVER (PARTITION BY conv_id // 3 ORDER BY conv_id) - 1 AS talk, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message FROM conversations),
corpus AS (
  SELECT path || '/0/0_conv' || talk || '_msg' || message AS corpus_id, role || ': ' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content, {{'p': path, 't': talk, 'm': message}} AS ord
  FROM placed JOIN paths USING (g) WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
{_hits_sql(10).replace("items AS (SELECT *", "stored AS (SELECT *").replace("FROM items'", "FROM stored'").replace("FROM items", "FROM stored").replace("JOIN items i", "JOIN stored i")}
{_scored_sql('(contains(lower(f.content), e.text) OR contains(e.text, lower(f.content)))')}
""")
def eval_evidence_talk(t):
    """Evidence messages found, by their text, among the best ten of all messages."""
    return evaluate.evaluate_set(evidence_talk(t), 10).select("question_id", "category", "recall_hit")


@query("eval_step_talk", f"""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, count(*) OVER (PARTITION BY conv_id) AS many FROM conversations),
kept AS (SELECT *, 'c' || (conv_id % 3) AS category, CASE WHEN conv_id % 2 = 0 THEN 'movie' ELSE 'roles' END AS topic FROM placed WHERE conv_id % 11 <> 10),
ranked AS (SELECT DISTINCT conv_id, category, topic, many FROM kept),
whole AS (SELECT DISTINCT conv_id, conv_id % 3 AS f, conv_id % 2 AS o FROM conversations),
places AS (SELECT conv_id, row_number() OVER (PARTITION BY f, o ORDER BY conv_id) - 1 AS no FROM whole),
questions AS (SELECT category || '_' || conv_id || '/' || topic || '/' || no AS question_id, category, '' AS owner, (SELECT min_by(text, turn) FROM conversations c WHERE c.conv_id = r.conv_id) AS question
              FROM ranked r JOIN places USING (conv_id)),
evidence AS (SELECT category || '_' || conv_id || '/' || topic || '/' || no AS question_id, category || '_' || conv_id || '_step_' || (many - 1) AS corpus_id FROM ranked JOIN places USING (conv_id)),
corpus AS (SELECT category || '_' || conv_id || '_step_' || step AS corpus_id,
                  '[t' || turn || '] [User] ' || CASE WHEN role = 'user' THEN text ELSE '' END || ' [Assistant] ' || CASE WHEN role = 'user' THEN '' ELSE text END AS content,
                  {{'c': category, 't': topic, 'n': conv_id, 's': step}} AS ord FROM kept),
{_hits_sql(10)}
{_scored_sql('e.corpus_id = f.corpus_id')}
""")
def eval_step_talk(t):
    """Target steps found among the best ten of all steps."""
    return evaluate.evaluate_set(step_talk(t), 10).select("question_id", "category", "recall_hit")
