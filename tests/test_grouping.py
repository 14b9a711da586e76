import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.operators import ensemble, evaluate, grouping


def plain_first(texts, fits):
    groups, first = [], []
    for i, t in enumerate(texts):
        at = next((g for g in groups if fits(g[0], i) and any(texts[m] in t or t in texts[m] for m in g)), None)
        if at is None:
            groups.append(at := [])
        at.append(i)
        first.append(at[0])
    return first


@pytest.mark.parametrize("seed", range(6))
def test_first_fit_is_the_fold(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = list({"".join(rng.choices("ab é", k=rng.randrange(0, 8))) for _ in range(rng.randrange(60))})
        kinds = [rng.randrange(3) for _ in texts]
        fits = lambda g, i: kinds[g] == kinds[i] or kinds[g] + kinds[i] == 3
        assert grouping.first_fit(texts, fits) == plain_first(texts, fits)
        theirs = ["".join(rng.choices("ab é", k=rng.randrange(0, 5))) for _ in range(20)]
        taken = set()
        for j, t in enumerate(theirs):
            at = next((i for i, x in enumerate(texts) if i not in taken and kinds[i] != j % 3 and (t in x or x in t)), None)
            taken |= {at} - {None}
        assert grouping.first_free(texts, theirs, lambda i, j: kinds[i] != j % 3) == len(taken)


LABELS = ["person", "name", "city", "location", "home address", "date", "dob", "organization", "weird", None, ""]


def findings(rng, key, n):
    word = lambda: rng.choice(["Asha", "Rao", "Acme", "12", "x", "Street 5", "é", " "])
    return [(key, " ".join(word() for _ in range(rng.randrange(1, 5))) + str(rng.randrange(n)), rng.choice(LABELS), rng.random(), [rng.choice("pq")], o) for o in range(n)]


def test_large_keys_are_grouped_as_small_ones(spark, monkeypatch):
    rng = random.Random(4)
    rows = [r for k in range(8) for r in findings(rng, k, rng.choice([1, 5, 150]))] + [(None, "v", "x", None, None, 0), (3, None, "x", 0.1, [], 1)]
    df = spark.createDataFrame(rows, "k long, value string, pii_type string, score double, found_by array<string>, ord int").repartition(3)
    got = [sorted(map(str, ensemble.dedupe_findings(df, ["k"]).collect())) for large in (0, 64, 10**9) if not monkeypatch.setattr(grouping, "LARGE", large)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 20


def test_large_evaluations_are_those_of_small_ones(spark, monkeypatch):
    rng = random.Random(9)
    sides = [[(k, o, "".join(rng.choices("ab", k=rng.randrange(0, 6))), rng.choice(LABELS)) for k in range(6) for o in range(rng.choice([3, 90]) if k else 90)] for _ in range(2)]
    sides[0] += [(1, None, "a", "x"), (1, 5, None, "x")]
    ours, theirs = (spark.createDataFrame(s, "k long, pos int, value string, label string") for s in sides)
    got = [sorted(map(str, evaluate.evaluate(ours, theirs, "k").collect())) for large in (0, 64, 10**9) if not monkeypatch.setattr(grouping, "LARGE", large)]
    assert got[0] == got[1] == got[2]
    pairs = evaluate.candidates(ours, theirs, "k")
    held = F.contains("value", "other") | F.contains("other", "value")
    every = ours.withColumnRenamed("pos", "our_pos").join(theirs.select("k", F.col("pos").alias("their_pos"), F.col("value").alias("other"), F.col("label").alias("said")), "k")
    every = every.where(held & evaluate.agrees(F.col("label"), F.col("said"), evaluator=True)).select("k", "our_pos", "their_pos")
    assert sorted(map(str, pairs.collect())) == sorted(map(str, every.collect())) and pairs.count() > 100


def test_fifty_thousand_findings_of_one_file(spark):
    value = F.concat(F.lit("user"), F.col("id") % 25_000, F.lit("@example.com"), F.when(F.col("id") < 25_000, F.lit("")).otherwise(F.lit(", again")))
    df = spark.range(50_000).select(F.lit(1).alias("k"), value.alias("value"), F.lit("email").alias("pii_type"), F.lit(0.5).alias("score"), F.array(F.lit("p")).alias("found_by"), F.col("id").cast("int").alias("ord"))
    began = time.time()
    got = ensemble.dedupe_findings(df, ["k"]).select("value").collect()
    assert time.time() - began < 30
    assert len(got) == 25_000 and all(r.value.endswith(", again") for r in got)
