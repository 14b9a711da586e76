import math
import random

import pytest
from pyspark.sql import functions as F

from veilspark.llm import quality

from .helpers import duck, empty_documents, named, odd_documents


def test_tail_is_the_exact_binomial_one(spark):
    cases = [(n, k, 0.02) for n in (1, 10, 300, 1000) for k in range(0, n + 1, max(1, n // 7))]
    df = spark.createDataFrame([(n, k) for n, k, _ in cases], "n long, k long")
    got = {(r.n, r.k): r.p for r in df.select("n", "k", quality.tail(F.col("n"), F.col("k"), 0.02).alias("p")).collect()}
    for n, k, p in cases:
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert got[n, k] == pytest.approx(1.0 if k > n * p else want, rel=1e-9)


def plain_repeats(text):
    w = (text or "").encode().split()
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + d for i, t in enumerate(tri) if tri.count(t) > 1 for d in range(3)})


def test_repeated_words_against_counting(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)] + ["a a a a a", "a b", "a b c", "a b c a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.measures(docs).collect()}
    assert got == {i: plain_repeats(t) for i, t in enumerate(texts)}


def test_odd_rows_against_sql(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(3, 1), (5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels).drop("stratum")
    assert named(got) == duck(quality.OP6_SQL, documents=docs, labels=labels)
    none = labels.limit(0)
    assert quality.judge(empty_documents(spark), none).collect() == []
    assert quality.judge(docs, none).where("kept = base_failed").count() == 0


def test_cutoffs_hold_the_risk_and_reject_junk(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(3000):
        junk = i % 10 == 0
        docs.append((i, " ".join(rng.choice(words) + ("%%%" if junk else "") for _ in range(60)), "en" if i % 2 else "fr"))
        labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judge(docs, labels)
    assert got.where("kept AND doc_id % 10 = 0").count() == 0 and got.where("NOT kept AND doc_id % 10 != 0").count() == 0
    assert named(got.drop("stratum")) == duck(quality.OP6_SQL, documents=docs, labels=labels)
    few = quality.judge(docs, labels.where("doc_id < 50"))
    assert few.where("NOT kept AND NOT base_failed").count() == 0  # nothing is certified on a few labels
