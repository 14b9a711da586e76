"""Reports that are counted, of documents in slices: as full reports have them, whatever is left on disk."""

import os

from pyspark.sql import functions as F

from veilspark import checkpoints
from veilspark.operators import report
from veilspark.plans import pipeline
from veilspark.plans.pipeline import in_slices, process


def odd_docs(spark):
    mails = " ".join(f"mail user{i}@example.com and USER{i}@example.com, PAN ABCDE{i:04d}F" for i in range(120))
    texts = [mails, "", None, "   ", "none here", "a@example.com, a@example.com.org born 1990-08-01", "word " * 900, "card 4111 1111 1111 1111 x@y.org"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"call +44 20 7946 {i:04d}, n{i}@example.com " + "pad " * (i * 30)) for i in range(20)] + [(None, "z@example.com")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_counts_are_those_of_full_reports(spark):
    done = process(odd_docs(spark))
    files = report.file_reports(done.chunk_reports())
    meta = report.run_meta(files)
    logs = report.chunk_logs(meta)
    counted = report.logged(*done.parts())
    assert counted.columns == logs.columns and [f.dataType for f in counted.schema] == [f.dataType for f in logs.schema]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(counted.collect(), key=key) == sorted(logs.collect(), key=key)
    want = files.select("doc_id", F.size("all_findings"), F.size("all_replacements"), "chunks_anonymized", "chunks_not_anonymized")
    want = want.join(meta.select(F.col("doc_id").alias("d"), "entity_types", "chunks_processed"), F.expr("doc_id <=> d")).drop("d")
    got = report.file_counts(*done.parts()).select("doc_id", "n_findings", "n_replacements", "chunks_anonymized", "chunks_not_anonymized", "entity_types", "chunks_processed")
    assert [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in want.schema]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.where("chunks_processed > 3").count() > 0


def test_slices_give_the_rows_of_the_whole_and_leave_only_them(spark, monkeypatch):
    docs = odd_docs(spark)
    for made in (lambda done: report.logged(*done.parts()), lambda done: report.file_counts(*done.parts())):
        key = lambda r: tuple((x is not None, x) for x in r)
        whole = sorted(map(tuple, in_slices(docs, made).collect()), key=key)
        checkpoints.shared_dir(spark)
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        before = set(os.listdir(folder))
        monkeypatch.setattr(pipeline, "SLICE_CHARS", 8000)
        sliced = in_slices(docs, made)
        monkeypatch.undo()
        left = set(os.listdir(folder)) - before
        assert 2 <= len(left) <= 6  # one for each slice
        assert sorted(map(tuple, sliced.collect()), key=key) == whole


def test_no_texts_at_all(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert in_slices(none, lambda done: report.logged(*done.parts())).collect() == []
    assert in_slices(none.limit(0), lambda done: report.file_counts(*done.parts())).collect() == []


def test_what_fails_leaves_nothing_either(spark):
    folder = None

    def make():
        nonlocal folder
        checkpoints.checkpoint(spark.range(5).toDF("id"))
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        raise ValueError

    checkpoints.shared_dir(spark)
    before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    try:
        checkpoints.alone(spark, make)
    except ValueError:
        pass
    assert set(os.listdir(folder)) == before and checkpoints._MADE.get() is None
