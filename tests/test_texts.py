import hashlib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.functions import vectors
from loci.operators import chunking, classify, entities, evaluate, linking, registry, relations, transcripts


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def test_ids(spark):
    name = "drawer_w_r_1"
    assert one(spark, lambda c: tx.point_id(c), name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "loci." + name))
    key = hashlib.md5(b"/a/b.txt3").hexdigest()[:16]
    assert one(spark, lambda c: tx.mined_drawer_id(F.lit("w"), F.lit("r"), c, F.lit(3)), "/a/b.txt") == f"drawer_w_r_{key}"


@pytest.mark.parametrize("text,want", [(" Laravel?  ", "laravel"), ("PHP-framework", "php framework"), ("Été à  Zürich", "ete a zurich"), (None, "")])
def test_normalize(spark, text, want):
    assert one(spark, tx.normalize_text, text) == want


def test_ascii_boundaries(spark):
    assert one(spark, lambda c: tx.regexp_hits(c, [r"\bfixed\b"]), "éfixed fixed prefixed fixed_it") == 2
    assert one(spark, lambda c: tx.regexp_hits(c, [r"\bfixed (it |the |by )\b"]), "fixed it now, fixed the .") == 1


def test_required_text():
    assert tx.required_text(r"\b(bug|error)\b") == ""
    assert tx.required_text(r"\blet'?s (use|go)\b") == "let"
    for patterns in fixed.MEMORY_MARKERS.values():
        for p in patterns:
            assert "\\" not in tx.required_text(p)


def test_chunks(spark):
    cut = lambda t: [(c.content, c.chunk_index) for c in one(spark, chunking.chunks, t)]
    assert len(cut("x" * 602)) == 1
    assert cut("short") == [] and cut(" \n ") == []
    long = "\n".join(f"line {i} with some words in it" for i in range(200))
    got = cut(long)
    assert len(got) > 1 and all(len(c) <= 810 for c, _ in got) and [i for _, i in got] == list(range(len(got)))
    para = "a" * 500 + "\n\n" + "b" * 900
    assert cut(para)[0][0] == "a" * 500
    # chunks cover the text and overlap by a hundred characters
    plain = "".join(chr(97 + i % 26) for i in range(3000))
    parts = [c for c, _ in cut(plain)]
    assert parts[0] + "".join(p[100:] for p in parts[1:]) == plain


def test_exchanges(spark):
    get = lambda t: [c.content for c in one(spark, chunking.exchanges, t)]
    text = "intro\n> What is memory, exactly?\nMemory is persistence.\n\n> Why does it matter so much?\nContinuity.\n---\nnot part\n> ok"
    assert get(text) == ["> What is memory, exactly?\nMemory is persistence.", "> Why does it matter so much?\nContinuity."]
    many = "> a question that is long enough\n" + "\n".join(f"l{i}" for i in range(12)) + "\n> b\n> c"
    assert get(many)[0].split("\n")[1] == " ".join(f"l{i}" for i in range(12))
    short = one(spark, lambda c: chunking.exchanges(c, answer_lines=8), many)
    assert short[0].content.split("\n")[1] == " ".join(f"l{i}" for i in range(8))
    assert get("first paragraph that is long enough\n\nshort\n\nsecond paragraph that is long too")[1].startswith("second")
    block = "\n".join(f"some line number {i}" for i in range(60))
    assert [c.count("\n") for c in get(block)] == [24, 24, 9]


def test_convo_room(spark):
    room = lambda t: one(spark, lambda c: classify.convo_room(c), t)
    assert room("Let me fix this python function, we have a code error in the api") == "technical"
    assert room("the design pattern of this module and component") == "architecture"
    assert room("roadmap and sprint backlog with a deadline") == "planning"
    assert room("nothing here") == "general"
    assert one(spark, lambda c: classify.convo_room(c, 3000), "x" * 3000 + " python code api") == "general"
    assert one(spark, classify.convo_room, "x" * 3000 + " python code api") == "technical"


def test_memories(spark):
    def kinds(text):
        df = spark.createDataFrame([(1, text)], "original_id int, document string")
        return [(r.memory_type, r.chunk_index) for r in classify.extract_memories(df).orderBy("chunk_index").collect()]

    assert kinds("We decided to use it because the architecture is better than the other approach.") == [("decision", 0)]
    assert kinds("I prefer snake_case and we always use tabs, please never use spaces here.") == [("preference", 0)]
    assert kinds("It works! We finally solved it, a breakthrough, and shipped version 2.") == [("milestone", 0)]
    assert kinds("There is a bug, the crash keeps failing and we have no workaround for the problem.") == [("problem", 0)]
    assert kinds("I love you and I feel scared and sad, so sorry.") == [("emotional", 0)]
    assert kinds("The bug and the error crash and the problem and the issue, but now patched.")[0][0] == "milestone"
    assert kinds("short") == [] and kinds("") == []
    turns = "> I prefer tabs and never use spaces\nok\n> We decided because of the architecture\nfine\n> nothing to see here at all"
    assert len(kinds(turns)) == 2
    assert one(spark, classify.prose, "import os\n```\nx = 1\n```\nreal words here") == "real words here"


def test_detect_room(spark):
    rooms = [{"name": "frontend", "keywords": ["ui", "react"]}, {"name": "backend", "keywords": ["server"]}]
    room = lambda p, t: spark.createDataFrame([(p, t)], "p string, t string").select(classify.detect_room(F.col("p"), F.col("t"), rooms).alias("r")).first().r
    assert room("backend/app.py", "react react") == "backend"
    assert room("src/frontend.py", "") == "frontend"
    assert room("src/x_1.py", "the server and the SERVER, react") == "backend"
    assert room("src/x_1.py", "nothing") == "general"


def test_entities(spark):
    text = "Riley said hello.\nHey Riley, thanks. She asked Riley.\nRiley: yes\nThe The The Zed Zed"
    df = spark.createDataFrame([(1, text), (2, "We built Atlas. pip install Atlas and import Atlas, Atlas v2, Atlas.py")], "original_id int, document string")
    got = {r.name: r for r in entities.detect_entities(df).collect()}
    assert set(got) == {"Riley", "Atlas"}
    assert got["Riley"].type == "person" and got["Riley"].confidence == 0.99
    assert got["Atlas"].type == "project" and got["Riley"].person_signals[0] == "dialogue marker (1x)"
    lone = spark.createDataFrame([(3, "they saw Zed\nZed\nZed")], "original_id int, document string")
    r = entities.detect_entities(lone).first()
    assert (r.type, r.confidence) == ("uncertain", 0.4) and r.signals[-1].endswith("pronoun-only match")


def test_registry(spark):
    people = registry.seed_people(
        spark.createDataFrame([("Ever", "friend", "personal", 1), ("Maxwell", "boss", "work", 2)], "name string, relationship string, context string, ord long"),
        spark.createDataFrame([("Max", "Maxwell")], "alias string, canonical string"),
    )
    projects = spark.createDataFrame([("Atlas", 1)], "name string, ord long")
    asked = spark.createDataFrame(
        [("ever", "have you ever tried this"), ("Ever", "Ever said hi with Ever"), ("max", ""), ("ATLAS", ""), ("Foo", "")], "word string, context string"
    )
    got = {(r.word): (r.type, r.entity_name) for r in registry.lookup(asked, people, projects).collect()}
    assert got == {"ever": ("concept", "ever"), "Ever": ("person", "Ever"), "max": ("person", "Maxwell"), "ATLAS": ("project", "Atlas"), "Foo": ("unknown", "Foo")}
    q = spark.createDataFrame([(1, "What did Maxwell say?"), (2, "have you ever been")], "query_id int, query string")
    assert {(r.query_id, r.canonical) for r in registry.people_in_queries(q, people).collect()} == {(1, "Maxwell"), (1, "Max")}
    docs = spark.createDataFrame([(1, "Nora said so. Hey Nora! Nora told me.\nNora: she laughed")], "original_id int, document string")
    assert [r.name for r in registry.learn(people, docs, projects).collect()] == ["Nora"]
    pages = spark.createDataFrame(
        [("Saoirse", 404, None, None, None, None), ("Paris", 200, "standard", "Paris", "", "Capital of France, a city in"), ("Riley", 200, "standard", "Riley", "", "riley is a given name"),
         ("Mercury", 200, "disambiguation", "Mercury", "topics", "many")], "word string, status int, page_type string, title string, description string, extract string")
    assert {r.word: (r.inferred_type, r.confidence) for r in registry.classify_research(pages).collect()} == {
        "Saoirse": ("person", 0.7), "Paris": ("place", 0.8), "Riley": ("person", 0.9), "Mercury": ("ambiguous", 0.4)}


@pytest.mark.parametrize("text,day,dates,start,end", [
    ("Started 2026-01-02 and ended 2026-03-04.", None, ["2026-01-02", "2026-03-04"], "2026-01-02", "2026-03-04"),
    ("He left yesterday", "2026-04-08", ["2026-04-07"], "2026-04-07", None),
    ("Dün başladı", "2026-04-08", ["2026-04-07"], "2026-04-07", None),
    ("aujourd'hui", "2026-04-08", ["2026-04-08"], "2026-04-08", None),
    ("2026/02/03 then 2026-01-01", None, ["2026-01-01", "2026-02-03"], "2026-01-01", "2026-02-03"),
    ("nothing", "2026-04-08", [], "2026-04-08", None),
])
def test_temporal(spark, text, day, dates, start, end):
    df = spark.createDataFrame([(text, day)], "t string, d string")
    r = relations.with_temporal(df, "t", F.col("d")).first().temporal
    assert (r.dates, r.valid_from, r.ended) == (dates, start, end)


def test_facts_from_text(spark):
    people = registry.seed_people(spark.createDataFrame([("Alice", "", "work", 1)], "name string, relationship string, context string, ord long"))
    docs = spark.createDataFrame(
        [(1, "Alice uses Docker.\nAlice no longer uses Docker.", "2026-04-08"), (2, "nothing of note is said here", "2026-04-08")], "original_id int, document string, filed_at string"
    )
    got = relations.extract_facts(docs, people).orderBy("pos").collect()
    assert [(r.subject, r.predicate, r.object, r.valid_from, r.ended) for r in got] == [
        ("Alice", "uses", "Docker", "2026-04-08", None), ("Alice", "uses", "Docker", None, "2026-04-08")]


def test_sessions(spark):
    head = "Claude Code v1.0\n"
    lines = lambda rows: spark.createDataFrame([(rows,)], "l array<string>")
    at = lambda rows: lines(rows).select(transcripts.session_starts(F.col("l")).alias("r")).first().r
    assert at(["x", head, "a", "b", "c", head, "d"]) == [1, 5]
    assert at([head, "Ctrl+E to show 5 previous messages", *"abcdef"]) == []
    body = head + "⏺ 9:30 AM Monday, March 30, 2026\n> Fix the Login page!\n" + "Sam spoke\n" * 12
    text = "preamble\n" + body + body.replace("9:30 AM", "2:15 PM") + head + "tiny\n"
    got = transcripts.split_sessions(spark.createDataFrame([("dir/my log.txt", text)], "path string, content string"), min_lines=10).orderBy("part").collect()
    assert [r.part for r in got] == [1, 2]
    assert got[0].file_name == "my_log_2026-03-30_930AM_Sam_Fix-the-Login-page.txt" and got[0].content == body


def test_f1_and_recall(spark):
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat"), (2, "a", "b"), (3, "", "x")], "pair_id int, pred string, truth string")
    assert {r.pair_id: round(r.f1, 4) for r in evaluate.token_f1(pairs).collect()} == {1: 0.8, 2: 0.0, 3: 0.0}
    assert one(spark, evaluate.session_of, "D3:12") == "session_3"
    assert one(spark, evaluate.multiple_choice, "the answer is (b).") == "B"


def test_named_patterns_are_ruled_out_without_loss(spark):
    texts = [
        "Hey Ann, thanks  ann! HI Ann. Annsaid ann said\nANN: yes\n> Ann hi\n[Ann] \"Ann said", "Ann-core Ann.py Ann v2 Annv3 ann.JSON the Ann  system", "shipping Ann, shipped ann, ship Ann",
        "nothing of it", "Ann", "", None, "thank Ann, hitherto Ann, they Ann", "ΟΔΟΣ-x ΟΔΟΣvx",
    ]
    rows = [(t, n) for t in texts for n in ("Ann", "Ann Ann", "ΟΔΟΣ")]
    df = spark.createDataFrame(rows, "t string, n string").repartition(2)
    sets = [fixed.DIALOGUE_PATTERNS, fixed.PERSON_VERB_PATTERNS, fixed.PROJECT_VERB_PATTERNS, (fixed.DIRECT_PATTERN, fixed.VERSIONED_PATTERN, fixed.CODE_REF_PATTERN)]
    t, n = F.col("t"), F.col("n")
    for patterns in sets:
        may = F.zip_with(tx.may_match(F.lower(t), patterns), tx.beside_name(F.lower(t), patterns, n), lambda a, b: a & b)
        ready = tx.name_patterns(patterns, "mi")
        plain = F.array(*[F.regexp_count(t, F.replace(F.lit("(?mi)" + p.replace(r"\b", tx._BOUNDARY)), F.lit("{name}"), tx.quote_regex(n))) for p in patterns])
        got = df.select(t, n, may.alias("may"), tx.count_named(t, ready, n, may).alias("got"), plain.alias("all")).collect()
        assert all(r["got"] == (r["all"] if r["t"] is not None else [None] * len(patterns)) for r in got)
        assert patterns is not fixed.PERSON_VERB_PATTERNS or not any(any(r["may"]) for r in got if r["t"] == "Ann")


def test_lookup_sends_a_small_registry_and_leaves_the_words(spark, monkeypatch):
    people = registry.seed_people(spark.createDataFrame([("Grace", None, None, 1)], "name string, relationship string, context string, ord bigint"))
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["grace", "Atlas", None, "x"] * 5)], "id int, word string")
    projects = spark.createDataFrame([("Atlas", 1)], "name string, ord bigint")

    def found():
        df = registry.lookup(words, people, projects)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        return plan, sorted(map(str, df.select("id", "type", "entity_name").collect()))

    plan, sent = found()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    monkeypatch.setattr(registry, "MAX_BROADCAST", 0)
    plan, shuffled = found()
    assert "BroadcastHashJoin" not in plan and sent == shuffled


def test_marker_hits_equal_plain_counts(spark):
    """The cheap look before each pattern leaves no match out, and looks for more than one text of a pattern."""
    rng = random.Random(8)
    words = sorted({w for ps in fixed.MEMORY_MARKERS.values() for p in ps for w in re.findall("[a-z']+", p.replace(r"\b", " ").replace(r"\d", "7"))} | {"don't", "i'm", "7x", "40%", "v1.2"})
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(150)] + ["we decided it, i'm going to", "the bug was bad, keeps crashing", "let's go with it; lets use it", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    scores = classify.marker_scores(F.col("t"))
    for r in df.select("t", *[s.alias(k) for k, s in scores.items()]).collect():
        for kind, patterns in fixed.MEMORY_MARKERS.items():
            assert r[kind] == sum(len(re.findall(p, r.t, re.ASCII)) for p in patterns), (kind, r.t)
    none = spark.createDataFrame([(None,)], "t string").select(*[x.alias(k) for k, x in scores.items()]).first()
    assert none.asDict() == {"decision": 0, "preference": 0, "milestone": None, "problem": None, "emotional": None}
    assert ["we should", "we decided"] in [s[:2] for s in tx._signs(r"\bwe (should|decided|chose)\b")]
    assert tx._signs(r"\bover\b.*\bbecause\b") == [["over"], ["because"]]


def test_memories_of_turns_groups_and_code(spark):
    """Speaker turns, line groups and fenced code; moods are asked of problems only."""
    turns = "intro\nHuman: we decided to use it because of speed\nand more\n> why is the bug an error again\nAI: I love this, it is amazing"
    long = "\n".join(f"line {i} we decided to use the better approach" for i in range(30))
    code = "```\nimport os\n```\nthe bug was fixed and it works, so happy"
    df = spark.createDataFrame([(1, turns), (2, long), (3, code), (4, None), (5, "")], "original_id long, document string")
    got = {(r.original_id, r.chunk_index): (r.memory_type, r.content) for r in classify.extract_memories(df).collect()}
    assert [got[1, i][1].split("\n")[0][:6] for i in range(3)] == ["Human:", "> why ", "AI: I "]
    assert got[1, 0][1].endswith("and more") and len([k for k in got if k[0] == 2]) == 2
    assert got[3, 0][0] == "milestone" and {k[0] for k in got} == {1, 2, 3}
    plan = classify.extract_memories(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 4


ODD_SEGMENTS = [
    "Alice uses Docker.", "Rose said that Max was here, and rose petals fell", "the rose of Max", "`big kit` and 'Alice' \"Alice\" alice ALICE", "", None,
    "i we Team Redis redis REDIS co-op X-ray -dash well-known_thing", "naïve Éclair ÉCLAIR straße Straße ΟΔΟΣ'Α ΟΔΟΣ İstanbul", "a 1abc abc1 _x x_ x-1 é1a 1éb " + "L" * 70 + " " + "m" * 64,
    "“Acme Inc” 'Acme  Inc' \"two\r\nlines\" `x` ``  `` 'A very long name of four words'", "Mary Ann works on Atlas App with React", "Alice no longer uses Docker.", "zebra ²x Ⅷx x² Ⅷ",
]


def _odd(spark, monkeypatch, made):
    """What a function makes with the registry sent along, and word by word by joins."""
    people = registry.seed_people(
        spark.createDataFrame([("Alice", "", "work", 1), ("Rose", "", "", 2), ("Maxwell", "", "", 3), ("Mary", "", "", 4)], "name string, relationship string, context string, ord long"),
        spark.createDataFrame([("Max", "Maxwell"), ("Éclair", "Mary")], "alias string, canonical string"))
    projects = spark.createDataFrame([("Atlas", 1), ("rose", 2)], "name string, ord long")
    wiki = spark.createDataFrame([("zebra", "animal", 0.9, True), ("co-op", None, None, True), ("petals", "x", 0.2, True), ("fell", "x", 0.9, False)], "word string, inferred_type string, confidence double, confirmed boolean")
    out = []
    for most in (100_000, 0):
        monkeypatch.setattr(registry, "MAX_BROADCAST", most)
        assert (registry.table(people, projects, wiki) is None) == (most == 0)
        out.append(sorted((tuple(r) for r in made(people, projects, wiki).collect()), key=repr))
    return out


def test_entities_of_rows_are_those_of_joined_words(spark, monkeypatch):
    rows = [(i, s) for i, s in enumerate(ODD_SEGMENTS)] + [(0, "Alice uses Docker."), (1, "Docker and `Rose` by Max"), (None, "Alice is here"), (None, "Bob and alice")]
    segs = spark.createDataFrame(rows, "segment_id int, segment string").repartition(3)
    got, want = _odd(spark, monkeypatch, lambda *known: relations.link_entities(segs, *known))
    assert got == want and len(got) > 25


def test_words_of_pieces(spark):
    rows = [(s,) for s in ODD_SEGMENTS if s]
    df = spark.createDataFrame(rows, "s string").select(
        relations.candidate_tokens(F.col("s")).alias("w"), relations.quoted_phrases(F.col("s")).alias("q"), vectors.embedding_tokens(F.col("s")).alias("e"), "s",
        F.split("s", linking.BETWEEN).alias("p"))
    for r in df.collect():
        assert list(dict.fromkeys(w for p in r.p for w in linking.piece_words(p))) == r.w
        assert linking.phrases(r.s) == r.q
        assert "Σ" in r.s or [w for p in r.p for w in linking.spoken(p) if w] == r.e


@pytest.mark.parametrize("most", [None, 2])
def test_facts_of_rows_are_those_of_joined_words(spark, monkeypatch, most):
    texts = ["\n".join(s for s in ODD_SEGMENTS if s), "Alice uses Docker.\nAlice no longer uses Docker.", "Alice depends on Redis. The `Brand kit` is part of the stack Alice. Started 2026-01-02.", "nothing"]
    rows = [*enumerate(texts), (1, "Rose uses Docker.\nRose and Max work on Atlas."), (None, texts[1])]
    docs = spark.createDataFrame([(*r, "2026-04-08") for r in rows], "original_id int, document string, filed_at string").repartition(3)

    def made(*known):
        found = relations.extract_facts(docs, *known, most_entities=most)
        return found.withColumns({c: F.round(c, 8) for c in ("confidence", "semantic_score")})

    got, want = _odd(spark, monkeypatch, made)
    assert got == want and len(got) >= 2
