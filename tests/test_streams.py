"""Streams against tables: sessions with late events, staged facts completed later."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest

from loci.operators.store import DrawerTable
from loci.streaming import ingest, retry
from loci.streaming.sessions import session_stream, sessions

NOW = "2026-01-02T03:04:05.000000Z"
START = datetime(2024, 1, 1)
SCHEMA = "user string, at timestamp"


def by_hand(rows, gap):
    out = []
    for user in {r[0] for r in rows}:
        times = sorted(t for u, t in rows if u == user and t is not None)
        for i, t in enumerate(times):
            if i and (t - times[i - 1]).total_seconds() <= gap:
                out[-1][2], out[-1][3] = t, out[-1][3] + 1
            else:
                out.append([user, t, t, 1])
    return sorted(map(tuple, out), key=repr)


def events(seed, n, users):
    pick = random.Random(seed)
    return [(pick.choice(users), START + timedelta(seconds=pick.randrange(0, 40_000))) for _ in range(n)]


@pytest.mark.parametrize("gap", [30, 600])
def test_sessions_of_a_table(spark, gap):
    rows = events(1, 900, ["a", "b", None]) + [("hot", START + timedelta(seconds=20 * i)) for i in range(800)] + [("z", None), ("edge", START), ("edge", START + timedelta(seconds=gap)), ("a", START), ("a", START)]
    got = sessions(spark.createDataFrame(rows, SCHEMA).repartition(5), "user", "at", gap).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows, gap)
    assert sessions(spark.createDataFrame([], SCHEMA), "user", "at", gap).collect() == []


def test_sessions_of_a_stream(spark, tmp_path):
    """Late events that keep within the delay take part; the stream then gives what the table gives."""
    rows = sorted(events(2, 400, ["a", "b"]), key=lambda r: r[1])
    held_back = set(random.Random(3).sample(range(400), 120))
    order = [r for i, r in enumerate(rows) if i not in held_back]
    files = [order[k : k + 40] for k in range(0, len(order), 40)]
    ends = [f[-1][1] for f in files]
    late = 0
    for r in (rows[i] for i in sorted(held_back)):
        at = next((i for i, end in enumerate(ends) if end >= r[1]), len(files) - 1)
        # Behind the end of its file by 500 seconds at most: it may come with the next file.
        moved = at + 1 < len(files) and (ends[at] - r[1]).total_seconds() <= 500
        files[at + moved].append(r)
        late += moved
    assert late > 5
    far = ("never", START + timedelta(days=1))
    files += [[far], [("a", START)], [(far[0], far[1] + timedelta(days=1))]]  # a last event far ahead, and one too late to count
    src, out = tmp_path / "src", tmp_path / "out"
    for i, f in enumerate(files):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(f"{src}/n={i:03d}")
        os.utime(next((src / f"n={i:03d}").glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    found = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(f"{src}/*")
    query = session_stream(stream, "user", "at", 600, 600).writeStream.outputMode("append").foreachBatch(lambda df, i: found.extend(map(tuple, df.collect()))).option(
        "checkpointLocation", str(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r for r in found if r[0] != "never"), key=repr) == by_hand(rows, 600)


def staged(path, name, at, facts, diary=None):
    (path / name).write_text(json.dumps({"staged_at": at, "facts": facts, **({"diary_entry": diary} if diary else {})}))


def fact(text, vector, **more):
    return {"content": text, "palace": "p", "topic": "t", **({"vector": vector} if vector else {}), **more}


def test_a_file_completed_later(spark, tmp_path):
    src, v = tmp_path / "staging", [0.5] * 384
    src.mkdir()
    table = DrawerTable(spark, str(tmp_path / "t"))
    run = lambda **kw: ingest.run_ingest(spark, str(src), table, str(tmp_path / "c"), NOW, **kw)
    staged(src, "1.json", "2026-01-01T00:00:00Z", [fact("whole", v), fact("waits", None), {"content": "no palace", "vector": v}], {"content": "dear diary"})
    (src / "2.json").write_text("{broken")
    run()
    assert sorted(r.document for r in table.current().collect()) == ["dear diary", "whole"]
    staged(src, "3.json", "2026-01-01T00:00:00Z", [fact("whole", v), fact("waits", v)])
    run()
    rows = table.log().collect()
    assert sorted(r.document for r in rows) == ["dear diary", "waits", "whole"]  # each once, in the log as well
    run()
    staged(src, "4.json", "2026-01-01T00:00:00Z", [fact("whole", v), fact("waits", v)])
    run()
    assert table.log().count() == 3
    saved = ingest.saves(spark, table)
    assert {(r.topic, r.items_saved) for r in saved.collect()} == {("t", 1)} and saved.count() == 2


def test_facts_are_given_up(spark, tmp_path):
    src = tmp_path / "staging"
    src.mkdir()
    found = []

    def run():
        stream = retry.once_whole(ingest.read_staged(spark, str(src)), "1 hour")
        q = stream.writeStream.foreachBatch(lambda df, i: found.extend((r.batch, r.pos, r.whole) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    first, soon, later = "2026-01-01T00:00:00Z", "2026-01-01T00:30:00Z", "2026-01-01T03:00:00Z"
    staged(src, "1.json", first, [fact("waits", None), fact("waits too", None)])
    run()
    staged(src, "2.json", soon, [fact("whole", [0.1] * 384)])
    staged(src, "3.json", first, [fact("waits", [0.1] * 384)])
    run()
    assert sorted(found) == [(first, 0, True), (soon, 0, True)]
    staged(src, "4.json", later, [fact("whole", [0.1] * 384)])
    run()
    staged(src, "5.json", first, [fact("waits", [0.1] * 384), fact("waits too", [0.1] * 384)])  # too late
    run()
    assert sorted(found) == [(first, 0, True), (first, 1, False), (soon, 0, True), (later, 0, True)]
