"""Question-set loaders on files, and evaluations by hand."""

import json

import pytest

from loci.operators import evaluate
from loci.sources import benchmarks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sets")
    (root / "memory.json").write_text(json.dumps([
        {"question_id": "a", "question_type": "t", "question": "red apple pie", "answer": 5, "question_date": "2023/05/01",
         "haystack_session_ids": ["s1", "s2", "s3"], "haystack_dates": ["d1", "d2", "d3"],
         "haystack_sessions": [[{"role": "user", "content": "red apple"}, {"role": "assistant", "content": "yes"}, {"role": "user", "content": "pie"}],
                               [{"role": "user", "content": "blue sky over the sea"}], [{"role": "assistant", "content": "nobody asked"}]],
         "answer_session_ids": ["s1"]},
        {"question_id": "b", "question": "sky", "haystack_session_ids": ["s2", "s1"],
         "haystack_sessions": [[{"role": "user", "content": "another text under a known id"}], [{"role": "user", "content": "red apple"}]], "answer_session_ids": []},
        {"question_id": "c", "question": "sea", "haystack_session_ids": ["s10"], "haystack_sessions": [[{"role": "user", "content": "green tea"}]], "answer_session_ids": ["s2"]},
    ]))
    (root / "talk.json").write_text(json.dumps([
        {"sample_id": "k", "conversation": {
            "speaker_a": "Kim", "session_1_date_time": "noon", "session_1": [{"speaker": "Kim", "dia_id": "D1:1", "text": "I adopted a cat"}, {"text": "no id"}],
            "session_2": [{"speaker": "Lee", "dia_id": "D2:1", "text": "the piano"}], "session_4": [{"speaker": "Lee", "dia_id": "D4:1", "text": "behind a gap"}]},
         "session_summary": {"session_1_summary": "a cat"},
         "qa": [{"question": "who adopted a cat", "answer": "Kim", "evidence": ["D1:1"], "category": 1}, {"question": "piano", "adversarial_answer": "none", "evidence": [], "category": 9}]},
        {"conversation": {"session_1": [{"speaker": "Zoe", "dia_id": "D1:1", "text": "same id elsewhere"}]}, "qa": [{"question": "zoe", "evidence": ["D1:1"], "category": 5}]},
    ]))
    (root / "broken.json").write_text('[{"question_id": "x"')
    (root / "empty.json").write_text("[]")
    for name, items in (("changing", [{"question": "color", "answer": "red", "message_evidences": [{"text": "RED"}],
                                       "conversations": [{"messages": [{"speaker": "U", "text": " my color is red "}, {"text": ""}, {"text": "hm"}]}, {"messages": [{"speaker": "U", "text": "my color is red"}]}]}]),
                        ("other", [{"question": "none", "message_evidences": [], "conversations": []}])):
        (root / "items" / name).mkdir(parents=True)
        (root / "items" / name / "f.json").write_text(json.dumps({"evidence_items": items}))
    (root / "steps").mkdir()
    (root / "steps" / "simple.json").write_text(json.dumps({
        "movie": [{"tid": 3, "message_list": [[{"user": "watch a film", "assistant": "ok", "time": "noon"}], [{"user_message": "again", "assistant_message": "sure"}, "no object"]],
                   "QA": {"question": "film", "choices": {"A": "x"}, "ground_truth": "a", "answer": "x", "target_step_id": [0, 1]}}, {"tid": 4, "message_list": [], "QA": {"question": "q"}}],
        "food": [{"tid": 9, "message_list": [{"user": "soup"}], "QA": {"question": "soup", "ground_truth": "b"}}],
        "events": [{"message_list": [{"user": "party"}], "QA": {"question": "party", "target_step_id": []}}]}))
    return str(root)


def test_long_memory(spark, folder):
    data = benchmarks.LongMemory(benchmarks.read(spark, f"{folder}/memory.json"))
    turns = sorted((r["question_id"], r["session_no"], r["turn_no"], r["session_id"], r["date"], r["role"], r["content"]) for r in data.turns().where("question_id = 'a'").collect())
    assert turns[0] == ("a", 0, 0, "s1", "d1", "user", "red apple") and len(turns) == 5 and turns[4][5] == "assistant"
    assert {r["corpus_id"]: r["content"] for r in data.corpus().collect()} == {"s1": "red apple\npie", "s2": "blue sky over the sea", "s10": "green tea"}
    assert {r["corpus_id"]: r["content"] for r in data.corpus("turn").collect()} == {
        "s1_turn_0": "red apple", "s1_turn_1": "pie", "s2_turn_0": "blue sky over the sea", "s10_turn_0": "green tea"}
    own = {(r["owner"], r["corpus_id"]): r["content"] for r in data.corpus(own=True).collect()}
    assert own["b", "s2"] == "another text under a known id" and own["b", "s1"] == "red apple" and len(own) == 5
    hits = {r["question_id"]: r for r in evaluate.evaluate_set(data, 1, "session").collect()}
    assert {q: r["recall_hit"] for q, r in hits.items()} == {"a": True, "b": None, "c": True} and hits["a"]["answer"] == "5"
    alone = {r["question_id"]: r["recall_hit"] for r in evaluate.evaluate_set(data, 5, "turn", own=True).collect()}
    assert alone == {"a": True, "b": None, "c": False}


def test_long_talk(spark, folder):
    data = benchmarks.LongTalk(benchmarks.read(spark, f"{folder}/talk.json"))
    rows = {(r["sample_id"], r["session_no"], r["dialog_no"]): r for r in data.dialogs().collect()}
    assert sorted(k for k in rows if k[0]) == [("k", 1, 0), ("k", 1, 1), ("k", 2, 0)] and rows["k", 1, 0]["date"] == "noon" and rows["k", 1, 0]["summary"] == "a cat"
    assert {r["corpus_id"]: r["content"] for r in data.corpus().collect()} == {"session_1": 'Kim said, "I adopted a cat"\n? said, "no id"', "session_2": 'Lee said, "the piano"'}
    assert {r["corpus_id"] for r in data.corpus("dialog").collect()} == {"D1:1", "D1:?", "D2:1"}
    hits = {r["question_id"]: r for r in evaluate.evaluate_set(data, 1, "dialog").collect()}
    assert {q: r["recall_hit"] for q, r in hits.items()} == {"k/0": True, "k/1": None, "unknown/0": True}
    assert hits["k/0"]["category"] == "Single-hop" and hits["k/1"]["category"] == "Cat-9" and hits["k/1"]["answer"] == "none"


def test_evidence_and_steps(spark, folder):
    data = benchmarks.EvidenceTalk(benchmarks.read(spark, f"{folder}/items"))
    texts = sorted(r["content"] for r in data.corpus().collect())
    assert texts == ["U: my color is red", "Unknown: hm"]
    hits = {r["category"]: r["recall_hit"] for r in evaluate.evaluate_set(data, 3).collect()}
    assert hits == {"changing": True, "other": None}

    steps = benchmarks.StepTalk(benchmarks.read(spark, f"{folder}/steps"), "movie")
    assert {r["corpus_id"]: r["content"] for r in steps.corpus().collect()} == {
        "simple_3_step_0": "[noon] [User] watch a film [Assistant] ok", "simple_3_step_1": "[User] again [Assistant] sure", "simple_0_step_0": "[User] party [Assistant] "}
    asked = {r["owner"]: r for r in steps.questions().collect()}
    assert set(asked) == {"simple_3", "simple_0"} and asked["simple_3"]["ground_truth"] == "A" and asked["simple_3"]["choices"] == {"A": "x"}
    assert {r["question_id"]: r["recall_hit"] for r in evaluate.evaluate_set(steps, 2).collect()} == {"simple_3/movie/0": True, "simple_0/events/0": None}


def test_broken_and_empty_files(spark, folder, tmp_path):
    for name in ("broken", "empty"):
        rows = benchmarks.read(spark, f"{folder}/{name}.json")
        for kind in (benchmarks.LongMemory, benchmarks.LongTalk, benchmarks.EvidenceTalk, benchmarks.StepTalk):
            assert kind(rows).questions().collect() == [] and kind(rows).corpus().collect() == []
    data = benchmarks.LongMemory(benchmarks.read(spark, f"{folder}/memory.json"))
    evaluate.save_results(evaluate.evaluate_set(data, 1, "session"), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert {x["question_id"]: x["recall_hit"] for x in lines} == {"a": True, "b": None, "c": True}


def test_step_files_in_pieces(spark, tmp_path):
    item = lambda n: {"tid": n, "message_list": [{"user": f"word{n}", "time": "t"}], "QA": {"question": f"word{n}", "target_step_id": [0]}}
    pieces = [({"movie": [item(1), item(2)], "roles": [item(3)]}, 0), ({"movie": [item(4)]}, 2), ({"roles": [item(5), item(6)]}, 1)]
    whole = {"movie": [item(1), item(2), item(4)], "roles": [item(3), item(5), item(6)]}
    one = benchmarks.StepTalk(spark.createDataFrame([("x/c.json", 0, json.dumps(whole))], "path string, at int, json string"), "movie")
    cut = benchmarks.StepTalk(spark.createDataFrame([("x/c.json", 0, json.dumps(p), n) for p, n in pieces], "path string, at int, json string, first int"), "movie")
    for part in ("corpus", "questions", "evidence"):
        got, want = (sorted(map(str, getattr(x, part)().collect())) for x in (cut, one))
        assert got == want and len(got) == 6


def test_step_talk_has_no_row_of_many_conversations(spark, tmp_path):
    from loci.plans import evaluation_queries, workload

    rows = [(c, n, ("user", "assistant")[n % 2], f"said {c} {n}") for c in [*range(40), None] for n in range(3)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = evaluation_queries.step_talk(workload.Tables(spark, str(tmp_path)))
    placed = [r.question_id.split("/") for r in made.questions().collect()]
    want = {}
    for c in range(40):
        want.setdefault((c % 3, c % 2), []).append(c)
    named = {f"c{f}_{c}/{('movie', 'roles')[o]}/{n}" for (f, o), cs in want.items() for n, c in enumerate(cs) if c % 11 != 10}
    assert {"/".join(p) for p in placed} == named and len(placed) == len(named)
    longest = made.items.select("path", "at", "item").groupBy("path").count().count()
    assert longest == 3 and made.entries.count() == 40
