import random

import os

import corpus_pipeline
from veilspark.llm import common, decontam, mixing, packing

from .helpers import empty_documents, odd_documents


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(800)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30) + ". " + text(8) + ".") for i in range(5)]
    docs = [(i, text(rng.randrange(60, 120)), "en", f"s{i % 3}") for i in range(400)]
    bad = [(1000 + i, f"{text(30)} idiotic {text(20)} scumbag {text(5)}", "en", "s1") for i in range(120)]
    copies = [(2000 + i, docs[i][1], "en", "s2") for i in range(20)]
    leaks = [(3000 + i, f"{text(40)} {t} {text(40)}", "en", "s0") for i, t in items]
    every = [(*d, len(d[1])) for d in docs + bad + copies + leaks]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame(every, kind).write.parquet(f"{folder}/documents.parquet")
    labels = [(d[0], 1, int(d[0] in range(1000, 2000))) for d in every if d[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = [r.doc_id for r in now.collect()]
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {d[0] for d in docs}
    assert set(seen["toxicity"]) == good | {d[0] for d in copies} | {d[0] for d in leaks}
    assert set(seen["near_duplicates"]) == good | {d[0] for d in leaks} and len(seen["near_duplicates"]) == 405
    assert sorted(seen["decontamination"]) == sorted(good)
    assert set(seen["mixing"]) <= good and sorted(seen["packing"]) == sorted(seen["mixing"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "packing"]
    assert corpus_pipeline.run(spark, folder).count() == len(seen["packing"])
    assert decontam and mixing and packing


def test_edited_copies_go(spark, tmp_path):
    rng = random.Random(9)
    docs = [" ".join(f"word{rng.randrange(800)}" for _ in range(200)) for _ in range(30)]
    copies = []
    for text in docs[:20]:
        words = text.split()
        words[50], words[120] = "edited", "changed"
        copies.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(docs + copies)), "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(30))


def test_odd_and_empty_tables(spark, tmp_path):
    labels = [(i, 1, 0) for i in range(12)] + [(None, None, None)]
    for name, docs in (("odd", odd_documents(spark)), ("empty", empty_documents(spark))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "no such question anywhere. Nor answer."), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        now, had = spark.read.parquet(f"{folder}/documents.parquet"), docs.count()
        for stage, f in corpus_pipeline.STAGES:
            made = f(spark, now, folder)
            assert stage == "packing" or made.columns == docs.columns
            made.write.parquet(f"{folder}/{stage}")
            now = spark.read.parquet(f"{folder}/{stage}")
        assert (now.count() > 0) == (had > 0)
        shared = common.shared_dir(spark).removeprefix("file://")
        before = {n for n in os.listdir(shared) if n.split("-")[0] in dict(corpus_pipeline.STAGES)} if os.path.isdir(shared) else set()
        assert corpus_pipeline.run(spark, folder).count() == now.count()
        left = {n.split("-")[0] for n in os.listdir(shared) if n.split("-")[0] in dict(corpus_pipeline.STAGES) and n not in before}
        assert left <= {"mixing", "packed"}
