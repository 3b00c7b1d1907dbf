import random

import pytest
from pyspark.sql import functions as F

from loci.operators import facts as kg
from loci.operators import skew, topology, transcripts
from loci.schemas import TRIPLES, conform

NOW = "2026-01-01"


def _store(spark, rows):
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, valid_from string, valid_to string, seq long")
    new = kg.add_triples(spark.createDataFrame([], TRIPLES), df, NOW)
    return new, kg.entities_of(kg.with_ids(df))


def test_ids(spark):
    df = kg.with_ids(spark.createDataFrame([("Max O'Neil", "Works On", "My App")], "subject string, predicate string, object string"))
    r = df.first()
    assert (r.subject_id, r.predicate, r.object_id) == ("max_oneil", "works_on", "my_app")


def test_as_of_direction_stats(spark):
    tri, ent = _store(spark, [
        ("Max", "does", "swimming", "2025-01-01", "2025-03-01", 1), ("Max", "loves", "chess", "2025-06-01", None, 2), ("Alice", "knows", "Max", None, None, 3),
        ("Max", "loves", "chess", "2025-07-01", None, 4),
    ])
    want = lambda day, how="outgoing": sorted(
        (r.direction, r.predicate) for r in kg.query_entities(tri, ent, spark.createDataFrame([("Max", day)], "entity string, as_of string"), how).collect()
    )
    assert tri.count() == 3
    assert want("2025-02-01") == [("outgoing", "does")]
    assert want("2025-03-01") == [("outgoing", "does")]
    assert want("2025-07-01") == [("outgoing", "loves")]
    assert want(None, "both") == [("incoming", "knows"), ("outgoing", "does"), ("outgoing", "loves")]
    s = kg.stats(tri, ent).first()
    assert (s.entities, s.triples, s.current_facts, s.expired_facts) == (4, 3, 2, 1)
    assert [r.predicate for r in kg.timeline(tri, ent).collect()] == ["does", "loves", "knows"]


def test_invalidate_and_duplicate(spark):
    tri, ent = _store(spark, [("Max", "has", "flu", "2025-01-01", None, 1)])
    again = kg.add_triples(tri, spark.createDataFrame([("max", "HAS", "Flu", 1)], "subject string, predicate string, object string, seq long"), NOW)
    assert again.count() == 0
    closed = kg.invalidate(tri, spark.createDataFrame([("Max", "has", "flu", "2025-02-15")], "subject string, predicate string, object string, ended string"), NOW)
    assert closed.first().valid_to == "2025-02-15"


def _fold(steps, stored):
    """Reconciliation one by one, as an agent would do it."""
    facts = [dict(f) for f in stored]
    out = {}
    for seq, key, start, end in steps:
        mine = [f for f in facts if f["key"] == key]
        active = [f for f in mine if f["to"] is None]
        if end is not None:
            if not active:
                out[seq] = "no_active_fact_to_invalidate"
            elif active[0]["from"] is not None and end < active[0]["from"]:
                out[seq] = "temporal_conflict_end_before_start"
            else:
                out[seq] = "invalidate"
                for f in active:
                    f["to"] = end
            continue
        last = max((f["to"] for f in mine if f["to"] is not None), default=None)
        if last is not None and start is not None and start < last:
            out[seq] = "temporal_conflict_start_before_previous_end"
        else:
            out[seq] = "add"
            if not active:
                facts.append({"key": key, "from": start, "to": None})
    return out, facts


def test_reconcile_equals_one_by_one(spark):
    """A hot fact (most rows), few dates, many repeats, a stored history."""
    rng = random.Random(3)
    days = [f"2025-0{m}-01" for m in range(1, 10)]
    steps = []
    for seq in rng.sample(range(100_000), 400):
        ends = rng.random() < 0.4
        steps.append((seq, "hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", rng.choice([*days, None]), rng.choice(days) if ends else None))
    steps.sort()
    stored = [{"key": "hot", "from": "2025-03-01", "to": None}, {"key": "k1", "from": "2025-01-01", "to": "2025-04-01"}]
    want, after = _fold(steps, stored)
    old = kg.with_ids(spark.createDataFrame([("s", "p", f["key"], f["from"], f["to"], str(i)) for i, f in enumerate(stored)], "subject string, predicate string, object string, valid_from string, valid_to string, id string"))
    old = conform(old, TRIPLES)
    df = spark.createDataFrame([("s", "p", k, a, b, 0.9, q) for q, k, a, b in steps], "subject string, predicate string, object string, valid_from string, ended string, confidence double, seq long").repartition(3)
    decided = kg.reconcile(old, df)
    got = {r.seq: r.reason or r.action for r in decided.collect()}
    assert got == want
    new, _ = kg.apply_reconciled(old, decided, NOW)
    key = lambda rows: sorted((str(a), str(b), str(c)) for a, b, c in rows)
    assert key((r.object_id, r.valid_from, r.valid_to) for r in new.collect()) == key((f["key"], f["from"], f["to"]) for f in after)


@pytest.mark.parametrize("hot_rows", [1, 100, 10**6])
def test_reconcile_streams_facts_and_spreads_hot_ones(spark, monkeypatch, hot_rows):
    """All, some or none of the facts are hot; a fact without a key is left out, ends alike in all have one outcome."""
    monkeypatch.setattr(kg, "HOT_ROWS", hot_rows)
    rng = random.Random(4)
    days = [f"2025-0{m}-01" for m in range(1, 10)]
    steps = [(seq, "hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", rng.choice([*days, None]), rng.choice(days) if rng.random() < 0.4 else None)
             for seq in range(0, 900, 3)]
    want, _ = _fold(steps, [{"key": "k1", "from": "2025-01-01", "to": "2025-04-01"}, {"key": "k2", "from": None, "to": None}])
    old = kg.with_ids(spark.createDataFrame([("s", "p", "k1", "2025-01-01", "2025-04-01", "a"), ("s", "p", "k2", None, None, "b"), ("s", "p", "other", None, None, "c")],
        "subject string, predicate string, object string, valid_from string, valid_to string, id string"))
    rows = [("s", "p", k, a, b, 0.12345, q) for q, k, a, b in steps]
    twice = [r for r in rows if want[r[6]] == "invalidate"]
    df = spark.createDataFrame([*rows, *twice, (None, "p", "hot", None, None, 0.9, 10**6)],
        "subject string, predicate string, object string, valid_from string, ended string, confidence double, seq long").repartition(3)
    found = kg.reconcile(conform(old, TRIPLES), df).collect()
    assert sorted((r.seq, r.reason or r.action) for r in found) == sorted([*want.items(), *[(r[6], "invalidate") for r in twice]])
    assert {r.confidence for r in found} == {0.123}
    assert all((r.active_valid_from is not None) == (r.reason == "temporal_conflict_end_before_start") for r in found)
    assert all((r.previous_valid_to is not None) == (r.reason == "temporal_conflict_start_before_previous_end") for r in found)


def test_reconcile_shuffles_the_rows_once(spark):
    df = spark.createDataFrame([("s", "p", "o", "2025-01-01", None, 0.9, 1)],
        "subject string, predicate string, object string, valid_from string, ended string, confidence double, seq long")
    decided = kg.reconcile(spark.createDataFrame([], TRIPLES), df)
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and "Join" not in plan


def test_segmented_windows(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", o, rng.random() < 0.3) for o in rng.sample(range(10**9), 900)]
    df = spark.createDataFrame(rows, "g string, o long, f boolean").repartition(4)
    got = {(r.g, r.o): (r.n, r.nx, r.pv) for r in skew.neighbours(
        skew.running_count(df, ["g"], "o", F.col("f"), "n"), ["g"], "o", {"nx": F.col("o")}, {"pv": F.col("f")}).collect()}
    for g in {r[0] for r in rows}:
        seq, n = sorted(r for r in rows if r[0] == g), 0
        for i, (_, o, f) in enumerate(seq):
            n += f
            assert got[g, o] == (n, seq[i + 1][1] if i + 1 < len(seq) else None, seq[i - 1][2] if i else None)


def test_pairing(spark):
    rows = [(1, 0, "user", "hello"), (1, 2, "system", "x"), (1, 3, "assistant", "hi"), (1, 4, "assistant", "more"), (1, 5, "user", "bye")]
    got = transcripts.pair_messages(spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")).orderBy("turn").collect()
    assert [(r.user_text, r.assistant_text) for r in got] == [("hello", "hi"), (None, "more"), ("bye", None)]


def test_topology(spark):
    rooms = spark.createDataFrame([("p1", "a", 1), ("p1", "b", 1), ("p2", "b", 2), ("p2", "c", 1), ("p3", "c", 1), ("p3", "d", 1), ("p4", "z", 1)], "palace string, slug string, drawer_count long")
    got = {r.slug: (r.distance, r.palace) for r in topology.traverse(rooms, "a", 3).collect()}
    assert got == {"b": (1, "p1"), "c": (2, "p2"), "d": (3, "p3")}
    assert topology.traverse(rooms, "nope", 2).count() == 0
    assert {(r.tunnel, r.palace_a, r.palace_b) for r in topology.tunnels(rooms).collect()} == {("b", "p1", "p2"), ("c", "p2", "p3")}
    s = topology.graph_stats(rooms).first()
    assert (s.palaces, s.rooms, s.drawers, s.tunnels) == (4, 7, 8, 2)
    via = {r.slug: r.via_tunnel for r in topology.traverse(rooms, "a", 2, via_tunnel=True).collect()}
    assert via == {"b": False, "c": True}


@pytest.mark.parametrize("name,want", [("a/b/My Palace.db", "my_palace"), ("", "default"), ("x\\y\\Z-1", "z_1")])
def test_namespace(spark, name, want):
    from loci.functions import text as tx

    assert spark.createDataFrame([(name,)], "n string").select(tx.namespace_id(F.col("n")).alias("n")).first().n == want


def test_embedded_scores_are_those_of_the_vector(spark):
    """Scores of a text against examples, without its vector leaving the task; long and empty texts, nulls."""
    import numpy as np
    from pyspark.sql import functions as F

    from loci.functions import vectors as vec

    df = spark.createDataFrame([(i, "word " * i + f"thing{i} Kim") for i in range(600)] + [(600, ""), (601, None)], "i int, text string")
    matrix = vec.unit_rows(np.random.default_rng(2).normal(size=(5, 384)))
    both = df.select(vec.embedded_scores(F.col("text"), matrix, spark).alias("a"), vec.candidate_scores(vec.embed(F.col("text")), matrix, spark).alias("b"))
    assert all(np.allclose(r.a, r.b, atol=2e-9) and len(r.a) == 5 for r in both.collect())


def test_few_names_are_sent_to_the_facts(spark):
    """Two objects hold all facts: a shuffle by object would put them in two tasks."""
    rows = [("default", f"s{i}", "p", f"o{i % 2}", "2020-01-01", None, i) for i in range(40)]
    triples = spark.createDataFrame(rows, "namespace string, subject_id string, predicate string, object_id string, valid_from string, valid_to string, seq long")
    triples = triples.selectExpr("*", "1D AS confidence", "'' AS source_closet", "string(seq) AS id")
    known = [("default", x, x.upper()) for x in [*{r[1] for r in rows}, *{r[3] for r in rows}]]
    entities = spark.createDataFrame(known, "namespace string, id string, name string")
    limit, few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), kg.FEW_IDS
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kg.FEW_IDS, merges in ((few, 0), (10, 1)):  # all names are few, or only those of the objects
            line = kg.timeline(triples, entities)
            assert line._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == merges
            assert [(r["subject"], r["object"]) for r in line.collect()] == [(x[1].upper(), x[3].upper()) for x in sorted(rows, key=lambda x: (x[1], x[3]))]
            wanted = entities.select(F.col("name").alias("entity"))
            both = kg.query_entities(triples, entities, wanted, "both").collect()
            assert sorted((r["direction"], r["subject"], r["object"]) for r in both) == sorted(
                (d, x[1].upper(), x[3].upper()) for x in rows for d in ("outgoing", "incoming"))
    finally:
        kg.FEW_IDS = few
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_first_spelling_in_one_pass(spark):
    rows = [("n", "a", "A1", "b", "B1", 3), ("n", "b", "B2", "a", "A2", 2), ("n", "a", "A3", "a", "A4", 1), ("n", "b", "B3", "c", "C1", None), ("n", "c", "C2", "d", "D1", 1)]
    facts = spark.createDataFrame(rows, "namespace string, subject_id string, subject string, object_id string, object string, seq long")
    assert {r["id"]: r["name"] for r in kg.entities_of(facts).collect()} == {"a": "A3", "b": "B3", "c": "C1", "d": "D1"}


def test_timeline_sends_odd_names_only(spark, monkeypatch):
    rows = [(n, f"s{i % 7}" if i % 9 else None, f"p{i % 2}", f"o{i % 3}", f"2024-0{1 + i % 4}-01" if i % 5 else None, "2024-09-01" if i % 3 else None, f"t{i}")
            for i, n in enumerate(["default"] * 30 + ["other"] * 6)]
    triples = spark.createDataFrame(rows, "namespace string, subject_id string, predicate string, object_id string, valid_from string, valid_to string, id string").repartition(3)
    # s1 is spelled otherwise, s2 unknown, s3 known twice, s4 nameless; all others are named like their ids.
    names = [("s0", "s0"), ("s1", "S 1"), ("s3", "s3"), ("s3", "S3"), ("s4", None), ("s5", "s5"), ("s6", "s6"), ("o0", "o0"), ("o1", "O1"), ("o2", "o2"), ("x", "X"), ("y", "Y")]
    entities = spark.createDataFrame([("default", *n) for n in names], "namespace string, id string, name string")

    def listed():
        out = kg.timeline(triples, entities)
        return out._jdf.queryExecution().executedPlan().toString(), [tuple(r) for r in out.collect()]

    _, want = listed()
    known = {}
    for i, name in names:
        known.setdefault(i, []).append(name)
    brute = [(f, t, s, p, o, t is None) for n, si, p, oi, f, t, _ in rows if n == "default" for s in known.get(si, []) for o in known.get(oi, [])]
    assert sorted(map(str, want)) == sorted(map(str, brute))
    monkeypatch.setattr(kg, "FEW_IDS", 11)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, got = listed()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, got)) == sorted(map(str, want)) and [r[0] for r in got] == [r[0] for r in want]
    assert "SortMergeJoin" not in plan and plan.count("rangepartitioning") == 1
    # Without a column id, the order is the same by what it is made of.
    by = [c for c in triples.columns if c != "id"]
    again = kg.timeline(triples.select(*by), entities, ident=F.concat_ws("_", "namespace", "subject_id")).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, want))
