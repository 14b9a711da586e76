import os
import shutil

import pytest

from veilspark.plans import jobs
from veilspark.sources import store
from veilspark.sources.versions import VersionedTable

SCHEMA = "k string, v int"


class Cut(Exception):
    pass


class Ends(VersionedTable):
    """A table whose job ends after so many steps."""

    left = 99

    def _step(self, what):
        self.left -= 1
        if self.left < 0:
            raise Cut(what)


def rows(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=str)


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


@pytest.mark.parametrize("steps", range(5))
@pytest.mark.parametrize("do", ["upsert", "remove", "clear"])
def test_a_write_cut_after_any_step_is_done_or_not(spark, tmp_path, steps, do):
    folder = str(tmp_path / "t")
    whole = VersionedTable(spark, folder, SCHEMA, "k", 4)
    for i in range(3):  # so that the next write also drops an old version
        whole.upsert(frame(spark, ("a", i), ("b", i), (f"c{i}", i)))
    before = rows(whole.read())
    change = {"upsert": lambda t: t.upsert(frame(spark, ("a", 9), ("z", 9))), "remove": lambda t: t.remove(frame(spark, ("a", 0))), "clear": lambda t: t.clear()}[do]
    after = {"upsert": [("a", 9), *before[1:], ("z", 9)], "remove": before[1:], "clear": []}[do]
    cut = Ends(spark, folder, SCHEMA, "k", 4)
    cut.left = steps
    try:
        change(cut)
        assert steps >= 4
    except Cut:
        pass
    now = rows(whole.read())
    assert now == (after if steps >= 2 else before)
    change(whole)  # and the next write finds a whole table
    assert rows(whole.read()) == sorted(after, key=str)
    whole.remove_orphans()
    assert rows(whole.read()) == sorted(after, key=str) and whole.orphans() == []


def test_an_upsert_rewrites_only_the_buckets_that_it_meets(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k")
    t.upsert(spark.range(2000).selectExpr("cast(id AS string) k", "1 v"))
    first = t.pointer()["parts"]
    t.upsert(frame(spark, *((str(i), 2) for i in range(10))))
    second = t.pointer()["parts"]
    assert len(first) == 64 and 0 < sum(first[b] != second[b] for b in first) <= 10
    assert t.read().count() == 2000 and t.read().where("v = 2").count() == 10
    assert t.read(1).where("v = 2").count() == 0 and t.versions() == [1, 2]
    assert t.read(1).count() == 2000


def test_old_versions_and_their_data_go(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 2)
    for i in range(6):
        t.upsert(frame(spark, ("a", i)))
    assert t.versions() == [4, 5, 6] and len(os.listdir(tmp_path / "t" / "data")) == 3 and rows(t.read(4)) == [("a", 3)]
    # The number of buckets is the table's own.
    VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 50).upsert(frame(spark, ("b", 1)))
    assert t.pointer()["buckets"] == 2 and rows(t.read()) == [("a", 5), ("b", 1)]


def test_two_writers_of_one_number(spark, tmp_path):
    class Late(VersionedTable):
        def _step(self, what):
            if what == "data written":
                VersionedTable(spark, self.folder, SCHEMA, "k").upsert(frame(spark, ("b", 2)))

    t = Late(spark, str(tmp_path / "t"), SCHEMA, "k")
    with pytest.raises(OSError):
        t.upsert(frame(spark, ("a", 1)))
    assert rows(t.read()) == [("b", 2)]


def test_nulls_empty_tables_and_odd_names(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "k")
    assert t.read().count() == 0 and t.versions() == []
    t.clear(), t.remove(frame(spark)), t.upsert(frame(spark))
    assert t.versions() == []
    t.upsert(frame(spark, (None, 1), ("", 2), ("a/b=c %41", 3)))
    t.upsert(frame(spark, (None, 4), ("", 5)))
    assert rows(t.read()) == [("", 5), ("a/b=c %41", 3), (None, 1), (None, 4)]
    s = store.RunStore(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], store.FILE)
    for run in ("run: 1/2=%41", "2"):
        s.write_run(run, "d", spark.createDataFrame([("a.txt",)], "file_name string"))
    s.write_run("2", "d", none)
    assert [r.run_id for r in s.runs().collect()] == ["run: 1/2=%41"]


def test_no_run_is_lost_where_a_run_is_written_over_a_table_put_aside(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path))
    one = spark.createDataFrame([("a.txt",)], "file_name string")
    s.write_run("r1", "d", one), s.write_run("r2", "d", one)
    shutil.move(tmp_path / "runs", tmp_path / ".runs.old")
    s.write_run("r3", "d", one)
    s.migrate()
    assert sorted(r.run_id for r in s.runs().collect()) == ["r1", "r2", "r3"]
    s.write_run("r2", "later", one)
    assert sorted((r.run_id, r.created_at) for r in s.runs().collect()) == [("r1", "d"), ("r2", "later"), ("r3", "d")]


def test_runs_of_an_earlier_release(spark, tmp_path):
    one = spark.createDataFrame([("a.txt", "d")], "file_name string, created_at string")
    for run in ("r1", "r2"):
        one.write.parquet(str(tmp_path / "runs" / f"run_id={run}"))
    spark.createDataFrame([("x",)], "file_name string").write.parquet(str(tmp_path / "deleted"))
    s = store.RunStore(spark, str(tmp_path))
    assert sorted(r.run_id for r in s.runs().collect()) == ["r1", "r2"] and [r.file_name for r in s.deleted().collect()] == ["x"]
    s.write_run("r3", "d", one.drop("created_at"))
    s.delete(spark.createDataFrame([("y",)], "file_name string"))
    assert sorted(r.run_id for r in s.runs().collect()) == ["r1", "r2", "r3"] and sorted(r.file_name for r in s.deleted().collect()) == ["x", "y"]


def test_a_scan_writes_its_metadata(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("write to asha@example.com or call +44 20 7946 0123")
    (tmp_path / "in" / "b.txt").write_text("nothing")
    s = store.RunStore(spark, str(tmp_path / "store"))
    jobs.scan(s, str(tmp_path / "in"), "r1", "2026-01-01")
    meta = {r.file_name: r for r in s.meta().collect()}
    found = {r.file_name: r for r in s.report().collect()}
    assert sorted(meta) == ["a.txt", "b.txt"] and meta["b.txt"].entity_count == 0
    assert meta["a.txt"].entity_count == len(found["a.txt"].all_findings) > 0 and meta["a.txt"].chunk_logs[0].agreed_count == len(found["a.txt"].chunks[0].findings)
    (total,) = jobs.run_totals(s).collect()
    assert (total.run_id, total.n_files, total.entity_count, total.replacements_count) == ("r1", 2, meta["a.txt"].entity_count, len(found["a.txt"].all_replacements))
