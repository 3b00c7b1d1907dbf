import numpy as np
import pytest
from pyspark.sql import functions as F

from loci.functions import vectors as vec
from loci.operators import consolidate, routing, search
from loci.operators.filters import compile_where, path_where


def test_path_where():
    assert path_where() == {}
    assert path_where(wing="w") == {"wing": "w"}
    assert path_where(room="r") == {"room": "r"}
    assert path_where(wing="w", room="r") == {"$and": [{"wing": "w"}, {"room": "r"}]}


def test_where_boolean(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "id int, wing string, room string")
    ids = lambda w: sorted(r.id for r in df.where(compile_where(w)).collect())
    assert ids({"wing": "a"}) == [1, 2]
    assert ids({"$and": [{"wing": "a"}, {"room": "x"}]}) == [1]
    assert ids({"$or": [{"wing": "a", "room": "y"}, {"wing": "b"}]}) == [2, 3]
    assert compile_where({}) is None


def test_top_k_of_many_queries(spark):
    """More query rows than one block takes, against numpy."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 3)).round(2)
    q = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "query_id long, vector array<double>")
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:300])], "item_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.item_id for r in vec.top_k(q, items, 2).collect()}
    u = vec.unit_rows(list(x))
    s = np.round(u @ u[:300].T, 9)
    order = np.lexsort((np.broadcast_to(np.arange(300), s.shape), -s), axis=1)[:, :2]
    assert got == {(i, k + 1): int(order[i, k]) for i in range(len(x)) for k in range(2)}


def test_block_hits_are_the_best_of_each_row():
    """Bounds, ties and the floor against a full sort, with many items per query."""
    rng = np.random.default_rng(8)
    qm, xm = vec.unit_rows(rng.normal(size=(7, 4)).round(1)), vec.unit_rows(rng.normal(size=(900, 4)).round(1))
    xm[5] = np.nan
    s = np.round(qm @ xm.T, vec.SCORE_DIGITS)
    for floor in (None, 0.9):
        hits = [vec._keep_best(found, 10) for found in vec._block_hits(qm, xm, 10, floor)]
        got = list(zip(*(c.tolist() for c in map(np.concatenate, zip(*hits)))))
        want = []
        for i, row in enumerate(s):
            held = [j for j in range(900) if j != 5 and (floor is None or row[j] >= floor)]
            want += [(i, j, row[j]) for j in sorted(held, key=lambda j: (-row[j], j))[:10]]
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want], atol=1e-9)


def test_blocks_are_cut_by_rows(spark):
    """Narrow vectors make several blocks, so that no task holds or multiplies all pairs."""
    df = spark.range(100_000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    assert vec._blocks(df, [], vec.BLOCK_QUERIES).first()["blocks"] == 7
    assert vec._blocks(df, [], vec.BLOCK_ITEMS).first()["blocks"] == 4


def _frame(spark, rows, name="original_id"):
    return spark.createDataFrame(rows, f"{name} long, palace string, vector array<float>")


@pytest.mark.parametrize("block", [None, 400])
def test_top_k_is_brute_force(spark, monkeypatch, block):
    """Ties, groups, hot copies; also with both sides cut in several blocks."""
    if block:
        monkeypatch.setattr(vec, "BLOCK_BYTES", block)
    monkeypatch.setattr(vec, "SCORE_CELLS", 64)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5)).round(1)
    x[::3] = x[0]  # a third of all rows are copies of one
    items = [(i, "abc"[i % 3], [float(v) for v in r]) for i, r in enumerate(x)]
    q = items[:12]
    u = vec.unit_rows([np.float32(i[2]) for i in items])
    s = np.round(u @ u.T, 9)
    for group in (None, "palace"):
        got = vec.top_k(
            _frame(spark, q, "query_id"), _frame(spark, items).repartition(5), 4, item_id="original_id", group=group, skip_same_id=True
        ).collect()
        want = {}
        for i, pal, _ in q:
            can = [j for j, p2, _ in items if j != i and (group is None or p2 == pal)]
            want[i] = sorted(can, key=lambda j: (-s[i, j], j))[:4]
        mine = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            mine.setdefault(r["query_id"], []).append(r["original_id"])
        assert mine == want


def test_rank_palaces_in_slices(spark, monkeypatch):
    ctx = spark.createDataFrame([(1, "php framework laravel", [1.0, 0.0]), (2, "", [0.0, 1.0])], "id int, text string, vector array<float>")
    pal = spark.createDataFrame(
        [("code", "laravel notes", ["php framework"], 10, [1.0, 0.1]), ("home", "family", ["kids"], 0, [0.0, 1.0]), ("misc", "", [], None, [1.0, 1.0])],
        "name string, description string, keywords array<string>, usage_count long, vector array<float>",
    )
    one = {r.id: [(c.name, round(c.score, 9)) for c in r.candidates] for r in routing.rank_palaces(ctx, pal).collect()}
    monkeypatch.setattr(routing, "REGISTRY_BYTES", 40)
    many = {r.id: [(c.name, round(c.score, 9)) for c in r.candidates] for r in routing.rank_palaces(ctx, pal).collect()}
    assert one == many
    assert one[1][0][0] == "code" and one[2][0][0] == "home"
    best = routing.rank_palaces(ctx, pal).where("id = 1").first().candidates[0]
    # description: one of three tokens, one of three phrases absent; keyword phrase +0.14
    assert best.field_boost == pytest.approx(min(0.25, 0.12 * 0.6 / 3 + 0.14))
    assert best.usage_boost == pytest.approx(np.log(11) * 0.02)




def test_audit_outcomes(spark):
    cand = "array<struct<name string, score double>>"
    rows = [
        ("a", 0.41, [("b", 0.81), ("a", 0.41)]), ("a", 0.79, [("a", 0.79), ("b", 0.2)]), ("a", 0.01, [("b", 0.04), ("a", 0.01)]),
        ("a", 0.50, [("b", 0.51), ("a", 0.5)]), ("a", None, []),
    ]
    df = spark.createDataFrame(rows, f"palace string, s double, c {cand}")
    got = [tuple(r.d)[:2] for r in df.select(consolidate.decide(F.col("palace"), F.col("s"), F.col("c")).alias("d")).collect()]
    assert got == [
        ("move", "better_palace_match_found"), ("keep", "current_palace_best_match"), ("keep", "best_score_below_threshold"),
        ("keep", "score_gap_too_small"), ("keep", "no_candidates"),
    ]


def test_quality_without_hits(spark):
    q = spark.createDataFrame([("a", "what database"), ("b", "of it")], "query_id string, query string")
    hits = spark.createDataFrame([("a", 1, 0.36, "a DATABASE, here"), ("a", 2, 0.2, "x")], "query_id string, rank int, similarity double, text string")
    got = {r.query_id: r for r in routing.result_quality(hits, q).collect()}
    assert got["a"].best_similarity == 0.36 and got["a"].avg_top_3_similarity == pytest.approx(0.28)
    assert got["a"].answer_coverage == pytest.approx(1 / 3)
    assert got["b"].quality_score is None and got["b"].answer_coverage == 0


def test_search_routed_fallback(spark):
    palaces = spark.createDataFrame(
        [("p1", "red apples", [1.0, 0.0, 0.0], 0), ("p2", "blue ships", [0.9, 0.1, 0.0], 0)], "name string, scope string, vector array<float>, usage_count long"
    )
    drawers = spark.createDataFrame(
        [("d1", "p1", "nothing at all", "w", "r", [0.0, 0.0, 1.0]), ("d2", "p2", "blue ships sail", "w", "r", [1.0, 0.0, 0.0])],
        "original_id string, palace string, document string, wing string, room string, vector array<float>",
    )
    ask = spark.createDataFrame([(1, "ships sailing", [1.0, 0.0, 0.0], None), (2, "ships sailing", [1.0, 0.0, 0.0], "p1")], "query_id int, query string, vector array<float>, palace string")
    hits, routes = search.search_routed(ask, palaces, drawers)
    by = {r.query_id: r for r in routes.collect()}
    assert by[1].searched_palace == "p2"
    assert by[2].searched_palace == "p1" and not by[2].fallback_checked and not by[2].remember
    assert {(r.query_id, r.original_id) for r in hits.collect()} == {(1, "d2"), (2, "d1")}
    memory = routing.remember(spark.createDataFrame([("Ships Sailing?", "p1", "direct_hit", "t", 1)], "query string, palace string, source string, ts string, seq long"))
    _, routes = search.search_routed(ask.where("query_id = 1"), palaces, drawers, memory)
    r = routes.first()
    assert r.memory_hit and r.fallback_used and r.routing_memory_refreshed and r.searched_palace == "p2"


def test_hot_copies(spark):
    rows = [(i, "same text " if i % 3 else f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "original_id int, document string")
    got = {r.original_id: (r.first_id, r.copies) for r in search.exact_copies(df).collect()}
    assert got == {i: (1, 200) for i in range(300) if i % 3}


def test_embed(spark):
    df = spark.createDataFrame([("Docker runs",), ("docker, RUNS!",), ("",), (None,)], "t string")
    v = [r.v for r in df.select(vec.embed(F.col("t")).alias("v")).collect()]
    assert v[0] == v[1] and len(v[0]) == 384 and sum(x * x for x in v[0]) == pytest.approx(1)
    assert set(v[2]) == {0.0} and set(v[3]) == {0.0}


def test_fields_are_compared_as_one_by_one():
    """The index of a registry's texts against every context and palace alone."""
    rng = np.random.default_rng(5)
    words = ["he", "she", "is", "this", "a", "cat", "at", "cathedral", "dock", "docker"]
    say = lambda n: " ".join(rng.choice(words, n))
    palaces = [
        {"fields": [{"text": say(m), "weight": weight} for m, weight in ((3, 0.08), (9, 0.12))][: i % 3], "keywords": [say(1), say(2), say(1)][: i % 4]}
        for i in range(60)
    ]
    index = routing.Fields(palaces)

    def plain(text, palace):
        seq = text.split()
        tokens, phrases = set(seq), {text} | {f"{a} {b}" for a, b in zip(seq, seq[1:])}
        total = extra = 0.0
        for f in palace["fields"]:
            has, inside = len(tokens & set(f["text"].split())) / len(tokens), sum(p in f["text"] for p in phrases) / len(phrases)
            total += min(f["weight"], has * f["weight"] * 0.6 + inside * f["weight"] * 0.4)
        for k in palace["keywords"]:
            extra += 0.14 if k in phrases else len(tokens & set(k.split())) / len(tokens) * 0.08
        return min(0.25, total + min(0.18, extra))

    for text in [say(n) for n in (1, 1, 2, 2, 3, 5, 9, 9, 30)] + ["unknown words only", "s"]:
        assert index.boosts(text).tolist() == [plain(text, p) for p in palaces]
    assert not index.boosts("").any() and routing.Fields([]).boosts("a").tolist() == []


def test_search_routed_works_vectors_out_once(spark, tmp_path):
    """Vectors worked out from texts meet both searches from one copy, and few hits are sent to the texts."""
    spark.createDataFrame([(f"d{i}", f"p{i % 3}", f"word{i} ships sail {i}") for i in range(30)], "original_id string, palace string, document string").write.parquet(f"{tmp_path}/d")
    drawers = search.with_vector(spark.read.parquet(f"{tmp_path}/d"), "document")
    palaces = search.with_vector(spark.createDataFrame([(f"p{i}", f"word{i} ships", 0) for i in range(3)], "name string, scope string, usage_count long"), "scope")
    ask = spark.createDataFrame([(1, "word4 ships"), (2, "nothing known here")], "query_id int, query string")
    hits, routes = search.search_routed(ask, palaces, drawers, None, 2)
    assert {r.query_id for r in routes.collect()} == {1, 2}
    assert {(r.query_id, r.rank) for r in hits.collect()} == {(q, k) for q in (1, 2) for k in (1, 2)}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "loci-kept" in hits._jdf.queryExecution().executedPlan().toString() or "ArrowEvalPython" not in plan
    found = search.search(ask.withColumn("palace", F.lit("p1")), drawers, 2, by_palace=True)
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
