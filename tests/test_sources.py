import json

from pyspark.sql import functions as F

from loci.sources import chat, files, gitignore


def _ignored(spark, rules, paths):
    r = gitignore.parse_rules(spark.createDataFrame(rules, "base string, content string"))
    entries = spark.createDataFrame(paths, "path string, is_dir boolean")
    return {x.path: x.ignored for x in gitignore.decisions(entries, r).collect()}


def test_gitignore(spark):
    got = _ignored(spark, [("", "# c\n*.log\nbuild/\n!keep.log\n/top.txt\ndocs/**/x.md\nfoo/bar\n[ab].c\n"), ("sub", "!a.log\n")], [
        ("a.log", False), ("keep.log", False), ("x/build/y.txt", False), ("build", True), ("build", False), ("top.txt", False), ("x/top.txt", False),
        ("docs/p/q/x.md", False), ("docs/x.md", False), ("foo/bar/z", False), ("foo/barn", False), ("a.c", False), ("plain", False), ("sub/a.log", False), ("sub/b.log", False),
    ] )
    assert got == {
        "a.log": True, "keep.log": False, "x/build/y.txt": True, "build": got["build"], "top.txt": True, "x/top.txt": None, "docs/p/q/x.md": True, "docs/x.md": True,
        "foo/bar/z": True, "foo/barn": None, "a.c": True, "plain": None, "sub/a.log": False, "sub/b.log": True,
    }
    assert _ignored(spark, [("", "build/\n")], [("build", True)]) == {"build": True}
    assert _ignored(spark, [("", "build/\n")], [("build", False)]) == {"build": None}


def _tree(tmp_path, content):
    for name, text in content.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_scan_and_mine(spark, tmp_path):
    long = "some words about the server and its api\n" * 40
    root = _tree(tmp_path, {
        ".gitignore": "secret/\n*.csv\n", "backend/a.py": long, "b.md": long, "c.bin": long, "secret/d.md": long, "node_modules/e.js": long,
        "data.csv": long, "tiny.txt": "x", "package-lock.json": long, "sub/.gitignore": "!data.csv\n", "sub/data.csv": long,
    })
    tree = files.read_tree(spark, root)
    names = lambda df: sorted(r.path for r in df.select("path").collect())
    assert names(files.scan_project(tree)) == ["b.md", "backend/a.py", "sub/data.csv", "tiny.txt"]
    assert names(files.scan_project(tree, include_ignored=["secret"])) == ["b.md", "backend/a.py", "secret/d.md", "sub/data.csv", "tiny.txt"]
    assert "data.csv" in names(files.scan_project(tree, respect_gitignore=False))
    log = files.mine_project(tree, wing="w", rooms=[{"name": "backend", "keywords": ["server"]}], palace="p", now="2026-01-01T00:00:00Z")
    rows = log.collect()
    assert {r.room for r in rows} == {"backend"} and len({r.original_id for r in rows}) == len(rows) and all(len(r.vector) == 384 for r in rows)
    assert files.mining_summary(log).first().files == 3
    assert files.unfiled(files.scan_project(tree).select("path"), log).collect()[0].path == "tiny.txt"
    sample = files.scan_for_detection(tree, 3)
    assert sample.count() == 3


def _read(spark, name, content):
    return chat.normalize(spark.createDataFrame([(name, content)], "path string, content string")).first()


def test_chat_formats(spark):
    jl = lambda *rows: "\n".join(json.dumps(r) for r in rows)
    want = "> What is it?\nA thing.\n"
    q, a = "What is it?", "A thing."
    assert _read(spark, "a.jsonl", jl({"type": "human", "message": {"content": q}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "A"}, "thing."]}})).transcript == want
    codex = [{"type": "event_msg", "payload": {"type": "user_message", "message": q}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": a}}]
    assert _read(spark, "a.jsonl", jl({"type": "session_meta"}, *codex)).format == "event_jsonl"
    assert _read(spark, "a.jsonl", jl(*codex)).format == "text"
    flat = [{"role": "user", "content": q}, {"role": "assistant", "content": a}]
    for data in (flat, {"messages": flat}, [{"chat_messages": flat}]):
        assert _read(spark, "x.json", json.dumps(data)).transcript == want
    node = lambda parent, role, text, kids: {"parent": parent, "message": role and {"author": {"role": role}, "content": {"parts": [text]}}, "children": kids}
    tree = {"mapping": {"r": node(None, None, "", ["u"]), "u": node("r", "user", q, ["a", "b"]), "a": node("u", "assistant", a, []), "b": node("u", "assistant", "other", [])}}
    assert _read(spark, "x.json", json.dumps(tree)).transcript == want
    loose = {"mapping": {"u": node(None, "user", q, ["a"]), "a": node("u", "assistant", a, ["u"])}}
    assert _read(spark, "x.json", json.dumps(loose)).transcript == want
    slack = [{"type": "message", "user": u, "text": t} for u, t in (("A", "one"), ("B", "two"), ("A", "three"), ("C", "four"))]
    got = _read(spark, "x.json", json.dumps(slack))
    assert [m.role for m in got.messages] == ["user", "assistant", "user", "assistant"]
    assert _read(spark, "notes.txt", json.dumps(flat)).transcript == want
    assert _read(spark, "x.txt", "> a\nb\n> c\n> d").format == "transcript"
    assert _read(spark, "x.json", "{not json").transcript == "{not json"
    assert _read(spark, "x.json", json.dumps(flat[:1])).format == "text"
    n = chat.count_user_lines(spark.createDataFrame([("p", jl({"message": {"role": "user", "content": "hi"}}, {"message": {"role": "user", "content": "<command-message>x"}}, {"message": {"role": "assistant"}}))], "path string, content string"))
    assert n.first().user_messages == 1


def test_mine_convos(spark, tmp_path):
    root = _tree(tmp_path, {"a.txt": "> What is a server api?\nIt is python code.\n> And a bug?\nAn error in the function.\n> ok\nfine", "b.meta.json": "{}", "memory/c.txt": "> x\n> y\n> z"})
    log = files.mine_convos(files.read_tree(spark, root), wing="w", palace="p", now="2026-01-01T00:00:00Z")
    rows = log.orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == [0, 1] and {r.room for r in rows} == {"technical"} and rows[0].extract_mode == "exchange"
    typed = files.mine_convos(files.read_tree(spark, root), wing="w", palace="p", now="2026-01-01T00:00:00Z", mode="general")
    assert typed.where(F.col("room") == "problem").count() == 1
