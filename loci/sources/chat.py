"""Chat exports of several tools, read into one transcript form.

Formats are told apart by content, in a fixed order.  JSON is taken apart with
Spark's variant functions inside the file's row, so a file stays in one row
and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions import text as tx

_MESSAGES = "array<struct<role:string,content:string>>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, prefix: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(prefix), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """A field that really is a string, else null."""
    inner = _get(v, path, "variant")
    return F.when(_is(inner, "STRING"), _get(v, path, "string"))


def content_text(v: Column) -> Column:
    """Text of a content value: string, list of strings and text blocks, or object."""
    blocks = F.transform(
        _get(v, "$", "array<variant>"),
        lambda b: F.when(_is(b, "STRING"), _get(b, "$", "string")).when(
            _text(b, "$.type") == "text", F.coalesce(_text(b, "$.text"), F.lit(""))
        ),
    )
    joined = F.array_join(F.filter(blocks, lambda b: b.isNotNull()), " ")
    return F.coalesce(
        tx.strip(
            F.when(_is(v, "STRING"), _get(v, "$", "string")).when(_is(v, "ARRAY"), joined)
            .when(_is(v, "OBJECT"), F.coalesce(_text(v, "$.text"), F.lit("")))
        ),
        F.lit(""),
    )


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def _usable(messages: Column) -> Column:
    """Messages with a role and a text; null unless there are two or more."""
    kept = F.filter(messages, lambda m: m["role"].isNotNull() & F.coalesce(m["content"] != "", F.lit(False)))
    return F.when(F.size(kept) >= 2, kept)


def _json_lines(content: Column) -> Column:
    lines = F.filter(F.transform(F.split(content, "\n"), tx.strip), lambda x: x != "")
    parsed = F.transform(lines, lambda x: F.try_parse_json(x))
    return F.filter(parsed, lambda v: v.isNotNull() & _is(v, "OBJECT"))


def _session_lines(content: Column) -> Column:
    """Lines {type: human|user|assistant, message: {content}}."""

    def one(v):
        kind = _text(v, "$.type")
        role = F.when(kind.isin("human", "user"), "user").when(kind == "assistant", "assistant")
        return _message(role, content_text(_get(v, "$.message.content", "variant")))

    return _usable(F.transform(_json_lines(content), one))


def _event_lines(content: Column) -> Column:
    """Lines {type: event_msg, payload: {type, message}} after a session_meta line."""
    lines = _json_lines(content)

    def one(v):
        kind = _text(v, "$.payload.type")
        role = F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant")
        role = F.when(_text(v, "$.type") == "event_msg", role)
        return _message(role, tx.strip(_text(v, "$.payload.message")))

    has_meta = F.exists(lines, lambda v: F.coalesce(_text(v, "$.type") == "session_meta", F.lit(False)))
    return F.when(has_meta, _usable(F.transform(lines, one)))


def _role_message(v: Column) -> Column:
    role = _text(v, "$.role")
    role = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai"), "assistant")
    return _message(role, content_text(_get(v, "$.content", "variant")))


def _role_list(data: Column) -> Column:
    """[{role, content}], {messages|chat_messages: [..]}, or [{chat_messages: [..]}]."""
    inner = F.coalesce(
        F.when(_is(data, "ARRAY"), data),
        F.when(_is(data, "OBJECT"), F.coalesce(_get(data, "$.messages", "variant"), _get(data, "$.chat_messages", "variant"))),
    )
    items = _get(inner, "$", "array<variant>")
    nested = _get(F.get(items, F.lit(0)), "$.chat_messages", "variant").isNotNull()
    chats = F.flatten(F.transform(
        items, lambda c: F.coalesce(_get(c, "$.chat_messages", "array<variant>"), F.array().cast("array<variant>"))
    ))
    return _usable(F.transform(F.when(nested, chats).otherwise(items), _role_message))


_NODES = "map<string,struct<parent:string,message:struct<author:struct<role:string>,content:string>,children:array<string>>>"


def _message_tree(content: Column) -> Column:
    """{mapping: {id: {parent, message, children}}}: from the root along first children."""
    nodes = F.from_json(F.get_json_object(content, "$.mapping"), _NODES)
    ids = F.map_keys(nodes)
    roots = F.filter(ids, lambda i: F.element_at(nodes, i)["parent"].isNull())
    bare = F.filter(roots, lambda i: F.element_at(nodes, i)["message"].isNull())
    root = F.coalesce(F.get(bare, F.lit(0)), F.get(roots, F.lit(0)))

    def step(acc, _):
        at = acc["at"]
        node = F.try_element_at(nodes, at)
        nxt = F.get(node["children"], F.lit(0))
        loop = at.isNull() | F.array_contains(acc["path"], at)
        return F.struct(
            F.when(~loop, nxt).alias("at"), F.when(loop, acc["path"]).otherwise(F.array_append(acc["path"], at)).alias("path")
        )

    start = F.struct(root.alias("at"), F.array().cast("array<string>").alias("path"))
    path = F.aggregate(ids, start, step, lambda acc: acc["path"])

    def one(i):
        node = F.try_element_at(nodes, i)
        role = node["message"]["author"]["role"]
        parts = _get(F.try_parse_json(node["message"]["content"]), "$.parts", "array<variant>")
        words = F.filter(
            F.transform(parts, lambda p: F.when(_is(p, "STRING"), _get(p, "$", "string"))), lambda t: F.coalesce(t != "", F.lit(False))
        )
        return _message(F.when(role.isin("user", "assistant"), role), tx.strip(F.array_join(words, " ")))

    return _usable(F.transform(path, one))


def _channel_list(data: Column) -> Column:
    """[{type: message, user, text}]: the first speaker is the user; a new speaker
    takes the other role than the message before."""
    items = F.transform(
        F.when(_is(data, "ARRAY"), _get(data, "$", "array<variant>")),
        lambda v: F.struct(
            F.coalesce(F.nullif(_text(v, "$.user"), F.lit("")), F.nullif(_text(v, "$.username"), F.lit(""))).alias("who"),
            tx.strip(F.coalesce(_text(v, "$.text"), F.lit(""))).alias("said"), (_text(v, "$.type") == "message").alias("ok"),
        ),
    )
    items = F.filter(items, lambda m: F.coalesce(m["ok"], F.lit(False)) & m["who"].isNotNull() & (m["said"] != ""))

    def step(acc, m):
        known = F.try_element_at(acc["roles"], m["who"])
        fresh = F.when(acc["last"] == "user", "assistant").otherwise("user")
        role = F.coalesce(known, fresh)
        roles = F.when(known.isNotNull(), acc["roles"]).otherwise(F.map_concat(acc["roles"], F.create_map(m["who"], role)))
        return F.struct(
            roles.alias("roles"), role.alias("last"), F.array_append(acc["out"], _message(role, m["said"])).alias("out")
        )

    start = F.struct(
        F.create_map().cast("map<string,string>").alias("roles"), F.lit(None).cast("string").alias("last"),
        F.array().cast(_MESSAGES).alias("out"),
    )
    return _usable(F.aggregate(items, start, step, lambda acc: acc["out"]))


def to_transcript(messages: Column) -> Column:
    """Messages as text: `> ` before the user's, the answer below, blank lines between."""

    def block(m, i):
        before = F.when(i > 0, F.get(messages, i - 1)["role"])
        after = F.get(messages, i + 1)
        answered = (m["role"] == "user") & (F.coalesce(after["role"], F.lit("")) == "assistant")
        taken = (m["role"] == "assistant") & (F.coalesce(before, F.lit("")) == "user")
        user = F.concat(F.lit("> "), m["content"])
        return F.when(taken, F.lit(None).cast("string")).when(
            answered, F.concat(user, F.lit("\n"), after["content"], F.lit("\n"))
        ).when(m["role"] == "user", F.concat(user, F.lit("\n"))).otherwise(F.concat(m["content"], F.lit("\n")))

    return F.array_join(F.filter(F.transform(messages, block), lambda b: b.isNotNull()), "\n")


def normalize(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Add format, messages and transcript to files (path, content).

    Text that is blank, has three `>` lines already, or is no known export
    passes through.
    """
    text = F.col(content)
    quoted = F.size(F.filter(tx.lines_of(text), lambda x: tx.strip(x).startswith(">"))) >= 3
    trimmed = tx.strip(text)
    looks_json = tx.extension(F.col(path)).isin(".json", ".jsonl") | F.left(trimmed, F.lit(1)).isin("{", "[")
    readable = looks_json & ~quoted & (trimmed != "")
    df = files.withColumn("_text", F.when(readable, trimmed)).withColumn("_data", F.try_parse_json(F.col("_text")))
    readers = {
        "session_jsonl": _session_lines(F.col("_text")), "event_jsonl": _event_lines(F.col("_text")),
        "role_list": _role_list(F.col("_data")), "message_tree": F.when(_is(F.col("_data"), "OBJECT"), _message_tree(F.col("_text"))),
        "channel_list": _channel_list(F.col("_data")),
    }
    tagged = [F.when(m.isNotNull(), F.struct(F.lit(n).alias("format"), m.cast(_MESSAGES).alias("messages"))) for n, m in readers.items()]
    df = df.withColumn("_m", F.coalesce(*tagged))
    return df.select(
        *files.columns,
        F.coalesce(F.col("_m.format"), F.when(quoted, "transcript").otherwise("text")).alias("format"),
        F.col("_m.messages").alias("messages"),
        F.when(F.col("_m").isNotNull(), to_transcript(F.col("_m.messages"))).otherwise(text).alias("transcript"),
    )


def count_user_lines(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """User messages per session file, command notices left out."""
    lines = _json_lines(F.col(content))

    def counts(v):
        said = F.coalesce(_text(v, "$.message.content"), F.lit(""))
        return F.coalesce(_text(v, "$.message.role") == "user", F.lit(False)) & ~F.contains(said, F.lit("<command-message>"))

    return files.select(path, F.size(F.filter(lines, counts)).alias("user_messages"))
