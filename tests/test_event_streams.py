import datetime
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import report
from veilspark.streaming import events

BEGIN = datetime.datetime(2026, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, kind string"


def at(minute):
    return BEGIN + datetime.timedelta(minutes=minute)


def drain(spark, tmp_path, make, batches):
    """Write batches of events one after the other, each read by a query that is started anew from its checkpoint; all rows it gave."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.fixture
def quiet(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_changes_of_a_stream_are_those_of_the_batch(quiet, tmp_path):
    rng = random.Random(3)
    all_events = [(i, rng.randrange(5), at(i * 0.5), rng.choice(["a", "b", None])) for i in range(200)]
    order = sorted(all_events, key=lambda e: (e[2] + datetime.timedelta(minutes=rng.randrange(0, 8))))  # up to 8 minutes out of order
    cut = [order[:70], order[70:130] + order[60:75], order[130:], [(9_999, 0, at(500), "end")]]  # some come twice
    cut[2] += [(777, 1, at(1), "too late"), (778, None, at(99), "x"), (779, 1, None, "x")]
    got = drain(quiet, tmp_path, lambda s: events.changes(s, "kind", "event_id", "user_id", "ts", "10 minutes"), cut)
    want = report.new_events(quiet.createDataFrame(all_events, SCHEMA), "kind", "ts", "user_id").select("user_id", "event_id", "kind")
    assert got.columns == ["user_id", "event_id", "kind"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100


STAGES = ("extract", "detect", "report")


def test_states_of_runs_and_those_that_stall(quiet, tmp_path):
    first = [(1, 7, at(0), "extract"), (2, 8, at(0), "extract"), (3, 7, at(5), "detect"), (4, 8, at(6), "odd")]
    second = [(6, 7, at(20), "report"), (5, 7, at(12), "detect"), (5, 7, at(12), "detect")]
    got = drain(quiet, tmp_path, lambda s: events.run_states(s, "kind", "event_id", "user_id", "ts", STAGES, "10 minutes", 30 * 60_000), [first, second, [(9, 9, at(200), "extract")], [(10, 9, at(201), "extract")]])
    minute = ((F.col("at") - F.unix_millis(F.lit(BEGIN)) ) / 60_000).cast("int").alias("minute")
    rows = {}
    for r in got.select("user_id", minute, "kind", "state").collect():
        rows.setdefault((r.user_id, r.minute, tuple()), {}).setdefault(r.kind, []).append(r.state)
    assert rows[7, 0, ()] == {"extract": ["active"], "detect": ["pending"], "report": ["pending"]}
    assert rows[7, 5, ()] == {"extract": ["done"], "detect": ["active"], "report": ["pending"]}
    assert rows[7, 20, ()] == {"extract": ["done"], "detect": ["done"], "report": ["active"]}
    assert sorted(rows[8, 0, ()]["extract"]) == ["active", "stalled"] and (7, 12, ()) not in rows
    states = quiet.createDataFrame([(s, c) for s in STAGES for c in STAGES], "s string, c string").select("s", "c", report.stage_state(F.col("c"), F.col("s"), STAGES).alias("x"))
    by = {(r.s, r.c): r.x for r in states.collect()}
    assert all(rows[7, m, ()][s] == [by[s, now]] for m, now in ((0, "extract"), (5, "detect"), (20, "report")) for s in STAGES)


def test_states_do_not_grow_with_groups(quiet, tmp_path):
    rows = [(i, i % 3000, at(i * 0.01), "ab"[i // 6000]) for i in range(9000)]
    quiet.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    found = events.changes(quiet.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "kind", "event_id", "user_id", "ts")
    query = found.writeStream.format("memory").queryName("many_groups").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(states) <= events.BUCKETS < 3000
    want = {(i % 3000, i, kind) for i, _, ts, kind in rows if (i < 3000 or i >= 6000) and ts <= at(8999 * 0.01 - 10)}
    assert {tuple(r) for r in quiet.table("many_groups").collect()} == want


def test_an_event_at_the_watermark_is_settled(quiet, tmp_path):
    got = drain(quiet, tmp_path, lambda s: events.changes(s, "kind", "event_id", "user_id", "ts", "10 minutes"), [[(1, 1, at(0), "a"), (2, 2, at(10), "b")]])
    assert [tuple(r) for r in got.collect()] == [(1, 1, "a")]


def test_groups_of_one_state_are_kept_apart(quiet, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randrange(6), at(i), rng.choice(STAGES)) for i in range(60)]
    cut = [rows[:40], rows[30:], [(99, 9, at(300), "extract")], [(98, 9, at(301), "report")]]
    got = {}
    for n in (1, 1024):
        monkeypatch.setattr(events, "BUCKETS", n)
        named = lambda s: s.withColumn("user_id", F.concat(F.lit("run "), "user_id"))
        found = drain(quiet, tmp_path / str(n), lambda s: events.run_states(named(s), "kind", "event_id", "user_id", "ts", STAGES, "10 minutes", 30 * 60_000), cut)
        got[n] = sorted(map(tuple, found.collect()))
    begin = int(BEGIN.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    want, last = [], {}
    for _, user, ts, kind in rows:
        if last.get(user, (None, None))[1] != kind:
            want.append((f"run {user}", kind, ts, "active"))
        last[user] = (ts, kind)
    want += [(f"run {user}", kind, ts, "stalled") for user, (ts, kind) in last.items() if kind != "report"]
    here = [(run, kind, BEGIN + datetime.timedelta(milliseconds=t - begin), state) for run, t, kind, state in got[1] if state in ("active", "stalled")]
    assert got[1] == got[1024] and sorted(w for w in here if w[0] != "run 9") == sorted(want) and len(got[1]) == 3 * len(here)
