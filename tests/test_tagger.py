import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect, tagger
from veilspark.plans import derived, learned


@pytest.mark.parametrize("seed", range(5))
def test_the_best_path_is_that_of_all_paths(seed):
    rng = np.random.default_rng(seed)
    tags = tagger.tags_of(["a", "b"][: 1 + seed % 2])
    ok = tagger.allowed(tags)
    for n in range(5):
        emit, steps = rng.integers(-3, 4, (n, len(tags))).astype(float), rng.integers(-3, 4, (len(tags) + 1, len(tags))) + ok
        path = tagger.best_path(emit, steps)
        value = lambda p: sum(emit[i, t] + steps[p[i - 1] if i else len(tags), t] for i, t in enumerate(p))
        best = max((value(p) for p in itertools.product(range(len(tags)), repeat=n)), default=0.0)
        assert len(path) == n and value(path.tolist()) == best
        for i, t in enumerate(path.tolist()):
            if tags[t][0] == "I":
                assert i and tags[path[i - 1]][0] != "O" and tags[path[i - 1]][1] == tags[t][1]


def test_tokens_shapes_and_marks():
    text = "Mr Ann Lee, 12-34 ünï"
    where = tagger.tokens_of(text)
    assert [text[a:b] for a, b in where] == ["Mr", "Ann", "Lee", ",", "12", "-", "34", "ünï"]
    assert [tagger.shape(w) for w in ("Abc", "A1-b", "abcdefgh", "12345", "")] == ["Xxx", "Xd-x", "xxxx", "dddd", ""]
    tags = tagger.tags_of(["id", "name"])
    spans = [{"start": 3, "end": 10, "label": "name"}, {"start": 7, "end": 10, "label": "id"}, {"start": 12, "end": 17, "label": "id"}, {"start": 18, "end": 21, "label": "other"}]
    assert [tags[t] for t in tagger.gold(text, where, spans, tags)] == [("O", ""), ("B", "name"), ("I", "name"), ("O", ""), ("B", "id"), ("I", "id"), ("I", "id"), ("O", "")]


def names(rng, n):
    """Texts with names and numbers that only their surroundings tell apart."""
    firsts, lasts = [f"{a}{b}" for a in ("Ma", "Lo", "Ti", "Ka") for b in ("ra", "na", "lo", "vi")], [f"{a}{b}" for a in ("Stan", "Gor", "Pel") for b in ("ford", "man", "ley")]
    out = []
    for i in range(n):
        first, last, no = rng.choice(firsts), rng.choice(lasts), str(rng.randrange(10**6))
        head = rng.choice(["Dear", "From", "Signed by"])
        text = f"{head} {first} {last}: order {rng.randrange(10**6)} of account {no} is on its way."
        at, num = text.index(first), text.index(f"account {no}") + 8
        spans = [{"start": at, "end": at + len(first), "label": "first name"}, {"start": at + len(first) + 1, "end": at + len(first) + 1 + len(last), "label": "last name"}]
        out.append((i, 1, text, [*spans, {"start": num, "end": num + len(no), "label": "bank account number"}]))
    return out


def test_what_is_learned_holds_for_other_texts(spark):
    schema = "doc_id long, chunk_index int, chunk string, spans array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame(names(random.Random(1), 300) + [(999, 1, None, None), (1000, 1, "", [])], schema).repartition(3)
    got = {r.label: r for r in tagger.held_out(df).collect()}
    assert set(got) == {"first name", "last name", "bank account number"}
    assert all(r.recall >= 0.95 and r.precision >= 0.95 and r.marked > 20 for r in got.values()), got
    model = tagger.fit(df)
    again = tagger.fit(df.repartition(7))
    assert model.labels == again.labels and np.array_equal(model.weights, again.weights)
    d = tagger.TaggerDetector(model, {"bank account number": "account"})
    found = d.detect(["Dear Loki Marley: order 1 of account 778899 is on its way.", "", "Mara\nGorman"])
    assert ("Loki Marley", "person") in [x[:2] for x in found[0]] and ("778899", "account") in [x[:2] for x in found[0]] and found[1] == []
    assert all(0.5 <= s <= 1 for each in found for _, _, s in each)
    chunks = spark.createDataFrame([(1, 1, "From Mara Gorman: order 5 of account 12 is on its way."), (2, 1, None)], "doc_id long, chunk_index int, chunk string")
    assert "Mara Gorman" in [r.text for r in d.apply(chunks, 0.5).collect()]


def test_no_spans_and_too_many_labels(spark):
    schema = "doc_id long, chunk_index int, chunk string, spans array<struct<start:int,end:int,label:string>>"
    empty = tagger.fit(spark.createDataFrame([(1, 1, "some text", [])], schema))
    assert empty.labels == () and empty.spans("some text") == []
    assert tagger.held_out(spark.createDataFrame([], schema)).collect() == []
    many = [(i, 1, "x", [{"start": 0, "end": 1, "label": f"l{i}"}]) for i in range(tagger.MOST_LABELS + 1)]
    with pytest.raises(ValueError):
        tagger.fit(spark.createDataFrame(many, schema))


def test_spans_that_patterns_mark(spark):
    chunks = derived.frame(spark, "/root/testdata/sf0.001", derived.ID_TEXTS).withColumnRenamed("text", "chunk")
    texts = tagger.marked(chunks, detect.recognise_all(chunks))
    r = texts.orderBy("doc_id").first()
    assert {r.chunk[s.start : s.end] for s in r.spans} <= {x.text for x in detect.recognise_all(chunks.where(f"doc_id = {r.doc_id}")).collect()} and len(r.spans) >= 3
    got = learned.QUERIES["tagger_held_out"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.right for r in got) >= 0.97 * sum(r.marked for r in got) and sum(r.right for r in got) >= 0.97 * sum(r.found for r in got)


def test_every_text_is_learned_from(spark, monkeypatch):
    """More texts than a fit once took: a label that only the last of them have, by the order of the old sample, is learned, and every text is seen."""
    monkeypatch.setattr(tagger, "PART_TEXTS", 1500)
    n = 4400
    rows = spark.range(n).selectExpr("id AS doc_id", "1 AS chunk_index", "concat('code ', id, ' end') AS chunk")
    late = rows.orderBy(F.xxhash64(F.lit("tagger"), "doc_id", "chunk_index")).offset(4000).select("doc_id").collect()
    late = {r.doc_id for r in late}
    schema = "doc_id long, chunk_index int, chunk string, spans array<struct<start:int,end:int,label:string>>"
    texts = [(i, 1, f"code {i} end", [{"start": 5, "end": 5 + len(str(i)), "label": "rare" if i in late else "common"}]) for i in range(n)]
    df = spark.createDataFrame(texts, schema)
    model = tagger.fit(df, rounds=1)
    assert model.labels == ("common", "rare")
    again = tagger.fit(df.repartition(9), rounds=1)
    assert np.array_equal(model.weights, again.weights)


@pytest.mark.parametrize("seed", range(3))
def test_texts_tagged_at_once_are_learned_from_one_by_one(seed):
    texts = [(text, spans) for _, _, text, spans in names(random.Random(seed), 60)] + [("", []), (" ", [])]
    random.Random(seed).shuffle(texts)
    tags = tagger.tags_of(["bank account number", "first name", "last name"])
    k, ok = len(tags), tagger.allowed(tags)
    start = np.random.default_rng(seed).integers(-1, 2, (tagger.FEATURES + k + 1, k)) * 0.25
    weights, weighed = start.copy(), np.zeros(start.shape)
    for step, (text, spans) in enumerate(texts):
        where = tagger.tokens_of(text)
        if not where:
            continue
        (rows,), want = tagger.features([(text, where)]), tagger.gold(text, where, spans, tags)
        got = tagger.best_path(tagger.emitted(weights, rows), weights[tagger.FEATURES :] + ok)
        for path, by in ((want, 1.0), (got, -1.0)):
            for table, size in ((weights, by), (weighed, by * (len(texts) - step))):
                np.add.at(table, (rows, path[:, None]), size)
                np.add.at(table, (tagger.FEATURES + np.r_[k, path[:-1]], path), size)
    change, mean = tagger.learn(texts, tags, start)
    assert np.array_equal(weights, start + change) and np.array_equal(weighed, mean) and change.any()
