import os
import shutil

from veilspark.conf import EngineConf
from veilspark.operators import detect, evaluate
from veilspark.plans import jobs
from veilspark.sources import store


class Names(detect.Detector):
    name, ord, setting = "names", 3, "zero_shot_threshold"

    def __init__(self, score=0.9):
        self.score = score

    def detect(self, texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no model")
        return [[(w, "person", self.score) for w in t.split() if w in ("Asha", "Boris")] for t in texts]


def folder(path):
    path.mkdir()
    (path / "a.txt").write_text("Asha wrote to asha@example.com and Boris")
    (path / "b.txt").write_text("boom bob@example.com")
    (path / "c.txt").write_text("nothing here")
    (path / "d.txt").write_text(" \n")
    return str(path)


def test_from_files_to_the_dashboard(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "store"))
    src = folder(tmp_path / "in")
    first = jobs.scan(s, src, "r1", "2026-01-01", EngineConf(min_agreement=1), detectors=[detect.RecogniserDetector(), Names()])
    rows = {r.file_name: r for r in first.collect()}
    assert sorted(rows) == ["a.txt", "b.txt", "c.txt", "d.txt"] and first.columns[-1] == "run_id"
    assert "asha@example.com" not in rows["a.txt"].anonymized_text and "Boris" not in rows["a.txt"].anonymized_text
    assert rows["c.txt"].all_findings == [] and rows["d.txt"].chunks == [] and rows["d.txt"].chunks_anonymized == 0
    jobs.scan(s, src, "r2", "2026-01-02", names=["c.txt"])
    assert [r.file_name for r in s.report().collect()] == ["c.txt"]

    new = {r.file_name: r for r in jobs.evaluate_runs(s, Names()).collect()}
    assert sorted(new) == ["a.txt", "b.txt", "c.txt"] and new["c.txt"].last_run_id == "r2" and new["a.txt"].last_run_id == "r1"
    assert new["a.txt"].llm_entities == 2 and new["a.txt"].same == 2 and new["a.txt"].recall_pct == 100.0
    assert "no model" in new["b.txt"].llm_error and (new["c.txt"].our_entities, new["c.txt"].llm_entities, new["c.txt"].recall_pct) == (0, 0, 0.0)
    again = jobs.evaluate_runs(s, detect.RecogniserDetector(), pending=True).collect()
    assert [(r.file_name, r.llm_error, r.same) for r in again] == [("b.txt", None, 1)]
    assert s.evaluations().count() == 3 and s.evaluations().where("llm_error IS NOT NULL").count() == 0
    s.delete(spark.createDataFrame([("a.txt",)], "file_name string"))
    assert jobs.evaluate_runs(s, Names(), names=["a.txt", "c.txt"]).count() == 1
    scans = store.latest_scans(s.runs())
    counts = s.runs().selectExpr("run_id", "file_name", "size(all_findings) AS our_entities")
    board = evaluate.dashboard(scans, counts, s.evaluations(), s.deleted()).collect()
    assert [r.file_name for r in board] == ["c.txt", "b.txt", "d.txt"] and [r.evaluated for r in board] == [True, True, False]


def test_a_detector_is_held_against_its_setting(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "store"))
    src = folder(tmp_path / "in")
    for run, least, n in (("r1", 0.28, 2), ("r2", 0.95, 0)):
        rows = jobs.scan(s, src, run, run, EngineConf(zero_shot_threshold=least), names=["a.txt"], detectors=[Names(0.5)])
        assert sum(f.pii_type == "person" for r in rows.collect() for f in r.all_findings) == n


def test_migration_rewrites_chunks_and_dropped_findings(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path))
    pan, low = ("ABCDE1234F", "suspicious_token", 0.9, ["gliner"]), ("x1", "city", 0.1, ["audit"])
    lost = [("Rome ", "city", 0.6, ["qwen"], "alone"), ("rome", "city", 0.5, ["presidio"], "weak"), ("y", "city", 0.1, None, "weak")]
    chunk = (1, "t", "u", [pan, low], [], lost, {"qwen": [("Rome", "city", 0.6), ("y", "city", 0.1)]})
    empty = (2, "v", "v", [], [], None, None)
    files = [("a.txt", "a.txt", "t", "u", [chunk, empty], [pan, low], [], lost, 1, 1), (None, None, None, None, [], None, None, None, 0, 0)]
    s.write_run("r1", "2026", spark.createDataFrame(files, store.FILE))
    s.migrate(0.3)
    a = s.runs().where("file_name = 'a.txt'").first()
    for found in (a.chunks[0].findings, a.all_findings):
        assert [(f.value, f.pii_type) for f in found] == [("ABCDE1234F", "pan number")]
    for found in (a.chunks[0].dropped_findings, a.all_dropped_findings):
        assert [(f.value, f.score, f.found_by, f.reason) for f in found] == [("Rome", 0.6, ["presidio", "qwen"], "alone")]
    assert [d.value for d in a.chunks[0].per_detector["qwen"]] == ["Rome"]
    assert a.chunks[1].findings == [] and a.chunks[1].dropped_findings is None and (a.chunks_anonymized, a.created_at) == (1, "2026")
    assert s.runs().count() == 2 and s.runs().where("file_name IS NULL").first().all_findings is None


def test_a_swap_cut_short_loses_nothing(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path))
    names = lambda *r: spark.createDataFrame([(n,) for n in r], "file_name string")
    s.delete(names("a"))
    shutil.move(tmp_path / "deleted", tmp_path / ".deleted.old")  # as if the job had ended between the two renames
    assert [r.file_name for r in s.deleted().collect()] == ["a"]
    s.delete(names("b"))
    assert sorted(r.file_name for r in s.deleted().collect()) == ["a", "b"] and not os.path.exists(tmp_path / ".deleted.old")
