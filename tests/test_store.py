import json

from pyspark.sql import functions as F

from loci.api import Memory
from loci.cli import main
from loci.functions.vectors import embed
from loci.operators import consolidate, saving, search, store
from loci.operators.memory import essential_story, illuminate, recall
from loci.operators.store import DrawerTable
from loci.streaming import counters, ingest

NOW = "2026-01-02T03:04:05.000000Z"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "original_id string, palace string, document string, wing string, room string")


def test_table(spark, tmp_path):
    t = DrawerTable(spark, str(tmp_path / "t"))
    t.upsert(_docs(spark, [("a", "p", "one", "w1", "r"), ("b", "p", "two", "w1", "r"), ("c", "q", "three", "w2", "r")]))
    assert t.count() == 3 and t.count("p") == 2
    t.upsert(_docs(spark, [("a", "p", "new", "w1", "r")]))
    assert t.current().where("original_id = 'a'").first().document == "new" and t.count() == 3
    t.delete(spark.createDataFrame([("p", "b")], "palace string, original_id string"))
    assert t.count() == 2
    t.compact()
    assert t.count() == 2 and t.log().count() == 2
    t.drop_palace("q")
    assert [r.original_id for r in t.current().collect()] == ["a"]


def test_recall_and_story(spark):
    df = _docs(spark, [(f"d{i}", "p", f"text\n {i} " + "y" * 250, "w", f"r{i % 3}") for i in range(30)]).withColumns(
        {"importance": F.lit(3.0), "hall": F.lit(""), "filed_at": F.lit(None).cast("string"), "source_file": F.lit("/a/longer.txt")}
    )
    r = recall(df, room="r1", limit=2).collect()
    assert len(r) == 2 and r[0].hall == "?" and r[0].content.startswith("text 1 y")
    text = essential_story(df).first().l1_essential
    assert text.startswith("## L1") and text.count("\n  - ") == 14 and "more available" in text
    pal = spark.createDataFrame([("p", "d", None, "I am", True), ("q", "", "", "", False)], "name string, description string, wing_focus string, l0_body string, is_default boolean")
    saves = spark.createDataFrame([("2026-01-01", 3, ["x", "y"])], "last_save_date string, items_saved long, topics array<string>")
    row = illuminate(pal, df, saves=saves, today="2026-01-02").first()
    assert row.l0_identity == "I am" and row.l1_recent_saves == "2026-01-01: 3 item saved (x, y)"
    assert illuminate(pal, df, saves=saves, today="2026-03-01").first().l1_recent_saves is None


def test_save_errors(spark):
    base = dict(content="c", palace="p", wing="w", hall="h", room="r", closet="c", topic="t", importance="3")
    bad = [{}, {"content": " "}, {"palace": ""}, {"hall": ""}, {"topic": None}, {"importance": "6"}, {"importance": None}]
    df = spark.createDataFrame([tuple({**base, **b}.values()) for b in bad], ", ".join(f"{k} string" for k in base))
    got = [r.e for r in df.select(saving.save_error(df).alias("e")).collect()]
    assert got[0] is None and [g.split(" ")[0].rstrip(",") for g in got[1:]] == ["content", "palace", "wing", "topic", "importance", "importance"]


def test_memory_end_to_end(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), now=lambda: NOW)
    m.setup("Kim", "likes tea", ["be brief"], ["never lie"], "French")
    assert m.palace_create("  My Work ", "docker and redis", ["docker"], "docker containers").first().name == "my_work"
    assert {r.name for r in m.list_identities().collect()} == {"personality_memory_palace", "my_work"}
    args = dict(palace="my_work", wing="Tech", hall="Ops", room="Docker", closet="Use", topic="docker", importance=4)
    first = m.save(content="Alice uses Docker.", **args).first()
    assert first.success
    again = m.save(content=" Alice uses Docker. ", **args).first()
    assert (again.success, again.error) == (False, "duplicate")
    assert m.save(content="", **args).first().error == "content is required"
    hits, routes = m.search("docker", palace="my_work")
    assert hits.first().text == "Alice uses Docker." and routes.first().searched_palace == "my_work"
    hits, routes = m.search("docker containers")
    assert routes.first().searched_palace == "my_work" and hits.count() == 1
    assert m._routes.read().count() == 1
    assert m.list_identities().where("name = 'my_work'").first().usage_count == 2
    assert [r.line for r in m.get_taxonomy("my_work").collect()] == ["Tech", "  Ops", "    Docker", "      Use"]
    assert m.kg_query("Alice", palace="my_work").first().predicate == "uses"
    a = m.kg_add("Max", "loves", "chess", "2025-01-01").first().id
    assert m.kg_add("Max", "loves", "chess").first().id == a
    m.kg_invalidate("Max", "loves", "chess", "2025-06-01")
    s = m.kg_stats().first()
    assert (s.triples, s.expired_facts, s.entities) == (1, 1, 2)
    m.diary_write("today I learned", "Kim Bot", "log", "s1")
    assert m.diary_read("kim bot").first().content == "today I learned"
    assert m.diary_search("learned", "Kim Bot").first().topic == "log"
    assert "Language: French" in m.illuminate().first().l0_identity
    did = m.drawers("my_work").first().original_id
    assert m.delete_drawer(did, "my_work").first().status == "queued_for_sleep_deletion"
    assert not m.delete_drawer("nope", "my_work").first().success
    assert m.consolidate("my_work", dry_run=False).first().action == "delete"
    assert m.drawers("my_work").count() == 0
    assert m.graph_stats().first().palaces == 2
    m.repair()
    assert m.status("personality_memory_palace").where("level = 'total'").first().drawers == 3


def test_move_is_one_append(spark):
    rows = _docs(spark, [("a", "p", "docker redis", "w", "r"), ("b", "q", "docker redis", "x", "y")])
    log = store.as_upserts(rows, 1)
    plan = spark.createDataFrame([("a", "p", "q")], "drawer_id string, from_palace string, to_palace string")
    after = store.current(log.unionByName(consolidate.move(store.current(log), plan, 2, NOW)))
    got = after.where("original_id = 'a'").collect()
    assert len(got) == 1 and got[0].palace == "q" and got[0].wing_name == "x" and got[0].consolidated_from_palace == "p" and got[0].needs_review is False


def test_staged_stream_is_idempotent(spark, tmp_path):
    staging = tmp_path / "staging"
    staging.mkdir()
    batch = {"staged_at": NOW, "project": "x", "facts": [
        {"content": "a fact", "palace": "p", "vector": [1.0, 0.0], "tags": ["a", "b"], "importance": 4, "topic": "t"},
        {"content": "no vector", "palace": "p"}], "diary_entry": {"content": "did things"}}
    (staging / "1.json").write_text(json.dumps(batch))
    (staging / "2.json").write_text("{broken")
    t = DrawerTable(spark, str(tmp_path / "t"))
    ingest.run_ingest(spark, str(staging), t, str(tmp_path / "c1"), NOW)
    rows = {r.palace: r for r in t.current().collect()}
    assert set(rows) == {"p", "sessions"} and rows["p"].tags == "a,b" and rows["p"].wing == "win_general"
    ingest.run_ingest(spark, str(staging), t, str(tmp_path / "c2"), NOW)  # everything once more
    assert t.count() == 2
    raw = spark.read.schema(ingest.STAGED).option("multiLine", "true").json(str(staging))
    assert ingest.incomplete(raw).count() == 1
    assert ingest.save_summary(t.current(), NOW).first().items_saved == 1


def test_save_counter_stream(spark, tmp_path):
    src = tmp_path / "src"
    msgs = [("s1", "user", "m")] * 31 + [("s1", "user", "<command-message>")] + [("s2", "assistant", "m")]
    spark.createDataFrame(msgs, "session_id string, role string, content string").write.parquet(str(src))
    seen = []
    stream = spark.readStream.schema("session_id string, role string, content string").parquet(str(src))
    q = counters.run_save_counter(stream, lambda df, i: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "c"))
    q.awaitTermination()
    assert seen == [("s1", 31, 2)]


def test_convo_stream(spark, tmp_path):
    src = tmp_path / "convos"
    src.mkdir()
    (src / "a.txt").write_text("> What is a server api?\nIt is python code.\n> And a bug?\nAn error in the code.\n> ok\nfine")
    t = DrawerTable(spark, str(tmp_path / "t"))
    run = lambda c: ingest.run_convo_ingest(spark, str(src), t, str(tmp_path / c), wing="w", palace="p", now=NOW)
    run("c")
    n = t.count()
    run("other")
    assert n == 2 and t.log().count() == 2


def test_command_line(spark, tmp_path, capsys):
    proj = tmp_path / "my-proj"
    (proj / "docs").mkdir(parents=True)
    (proj / "docs" / "a.md").write_text("notes about the design of the server\n" * 10)
    path = ["--path", str(tmp_path / "mem"), "--palace", "p"]
    assert main(["init", str(proj)], spark) == 0
    conf = json.loads((proj / "loci.json").read_text())
    assert conf["wing"] == "my_proj" and {r["name"] for r in conf["rooms"]} == {"documentation", "general"}
    main([*path, "mine", str(proj)], spark)
    main([*path, "status"], spark)
    main([*path, "search", "server design"], spark)
    out = capsys.readouterr().out
    assert "documentation" in out and "notes about" in out


def test_reads_of_the_log_are_narrow_and_pruned(spark, tmp_path):
    table = DrawerTable(spark, str(tmp_path / "log")).create()
    for palace in ("p1", "p2"):
        rows = spark.createDataFrame([(palace, f"{palace}-{i}", f"text {i}") for i in range(3)], "palace string, original_id string, document string")
        table.upsert(rows)
    assert table.count() == 6 and table.count("p1") == 3
    plan = table.current(["palace"]).where("palace = 'p1'")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "PartitionFilters: [isnotnull(palace" in scan and "document" not in scan and "vector" not in scan


def test_ids_may_repeat_across_palaces(spark):
    rows = [("p1", "a", "first text here", [1.0, 0.0]), ("p2", "a", "second text there", [1.0, 0.1]), ("p3", "b", "third", [0.0, 1.0])]
    drawers = spark.createDataFrame(rows, "palace string, original_id string, document string, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    hits = search.search(asked, drawers, 2).orderBy("rank").collect()
    assert [(h.palace, h.original_id, h.text) for h in hits] == [("p1", "a", "first text here"), ("p2", "a", "second text there")]


def test_new_palace_competes_in_its_first_batch(spark):
    known = spark.createDataFrame([("work", "docker and services", ["docker"], "docker and services", None, 3)],
                                  "name string, description string, keywords array<string>, scope string, l0_body string, usage_count long")
    known = known.withColumn("vector", embed(F.col("scope")))
    asked = spark.createDataFrame([(1, "garden_plants", "garden plants need water", "w", "h", "r", "c", "t", 3)],
                                  "seq long, palace string, content string, wing string, hall string, room string, closet string, topic string, importance int")
    log = saving.save_batch(asked, saving.empty_drawers(spark), known, version=1, now=NOW).log
    assert log.first().routing_best_palace == "garden_plants"


def test_closets_palaces_and_queued_deletes(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), now=lambda: NOW)
    m.palace_create("work", "w", [], "w")
    args = dict(palace="work", wing="Tech", hall="Ops", room="Docker", closet="Use", topic="docker", importance=4)
    m.save(content="Docker is in use.", **args)
    row = m.drawers("work").first()
    closet = m._closets("work").first().closet_id
    assert m.delete_drawer("clo_none", "work").first().error == "Closet not found: clo_none"
    assert m.delete_drawer(closet, "work").first().success
    assert m.get_taxonomy("work").isEmpty() and {r.child for r in m._edges("work").collect()} == {"Ops", "Docker"}
    assert m.delete_drawer(row.original_id, "work").first().status == "queued_for_sleep_deletion"
    assert m.flush_pending_deletes("work", dry_run=True).count() == 1 and m.table.count("work") == 1
    m.reembed()
    assert m.drawers("work").first().vector == row.vector
    assert m.flush_pending_deletes("work").count() == 1 and m.table.count("work") == 0
    m.palace_delete("work")
    assert m.list_identities().count() == 0
