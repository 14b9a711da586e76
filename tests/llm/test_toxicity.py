import math
import random
import re
import zlib

import numpy as np
import pytest

from veilspark.llm import toxicity

from .helpers import empty_documents, odd_documents

BAD = ("idiotic", "scumbag", "morons", "worthless")
WORDS = [f"word{i}" for i in range(500)]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(WORDS) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.3
        junk = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        docs.append((i, " ".join(w + ("%%%" if junk else "") for w in text)))
        labels.append((i, 0 if junk else 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 1)
    chain = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample_rows=400)
    others, truth = corpus(600, 2)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(others, "doc_id long, text string"), chain).collect()}
    right = [got[i].rejected == bool(t) for i, _, t in truth]
    assert sum(right) / len(right) > 0.97
    junk = [(got[i].p_low_quality > 0.5) == (q == 0) for i, q, _ in truth]
    assert sum(junk) / len(junk) > 0.9
    assert len(chain.models) == 3 and [len(m.v) for m in chain.models] == [0, 1, 2]  # each sees those before it


def plain_features(text):
    """Features as the module states them, from the text alone."""
    words = re.findall(rb"[^\s!-/:-@\[-`{-~]+", (text or "").lower().encode())
    ids = {zlib.crc32(w, 1) for w in words} | {zlib.crc32(w[:k], 2) for w in words for k in range(4, 8) if k <= len(w)}
    n, symbols = max(1, len(words)), sum((text or "").count(c) for c in "#*$%&|<>")
    ids |= {zlib.crc32(b"%d" % min(9, int(symbols / n * 20)), 3), zlib.crc32(b"%d" % int((1 - len(set(words)) / n) * 10), 4)}
    return {i % (1 << 22) for i in ids}


def rows_of(texts):
    found = [sorted(plain_features(t)) for t in texts]
    return toxicity.Rows.of(np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found]), len(found))


def test_chain_and_scores_against_a_plain_restatement(spark):
    docs, labels = corpus(400, 3)
    texts = [t for _, t in docs]
    assert [set(toxicity.features(t)) for t in [*texts, None, "", "### a a"]] == [plain_features(t) for t in [*texts, None, "", "### a a"]]
    rows, y = rows_of(texts), np.array([[q == 0, t == 1, q == 0 and t == 1] for _, q, t in labels], float)
    shift = np.array([0.0, -0.7, -0.7])
    chain = toxicity.Chain(rows, y, shift)
    # Out of fold: a model that has not seen the row, on top of such odds of the categories before.
    fold, before = np.arange(400) % 3, np.zeros((400, 0))
    for c in range(3):
        for f in range(3):
            m = toxicity.Linear(rows.where(fold != f), before[fold != f], y[fold != f, c])
            z = m.odds(rows.where(fold == f), before[fold == f]) + shift[c]
            assert np.allclose(chain.held_out[fold == f, c], 1 / (1 + np.exp(-z)))
        p = chain.held_out[:, c]
        before = np.column_stack([before, np.clip(np.log(p / (1 - p)), -9, 9)])
    # Scores: weights of a text's features, earlier categories' odds, and the shift, one category after the other.
    weights = [dict(zip(m.ids.tolist(), m.w.tolist())) for m in chain.models]
    frame = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.score(frame, chain).collect()}
    for i, text in [*docs, (900, None), (901, "")]:
        odds = []
        for c, m in enumerate(chain.models):
            z = m.b + shift[c] + sum(weights[c].get(f, 0) for f in plain_features(text)) + sum(v * o for v, o in zip(m.v, odds))
            odds.append(min(max(z, -9), 9))
        want = [1 / (1 + math.exp(-o)) for o in odds]
        assert list(got[i])[1:4] == pytest.approx(want, abs=1e-9) and got[i].rejected == (want[1] >= chain.reject)


def test_a_model_is_the_least_of_its_objective(monkeypatch):
    docs, labels = corpus(300, 4)
    rows, y = rows_of([t for _, t in docs]), np.array([t for *_, t in labels], float)

    def objective(m):
        z = m.odds(rows, np.zeros((300, 0)))
        return np.mean(np.log1p(np.exp(z)) - y * z) + toxicity.L1 * np.abs(m.w).sum()

    short = objective(toxicity.Linear(rows, np.zeros((300, 0)), y))
    monkeypatch.setattr(toxicity, "STEPS", 4000)
    assert short <= objective(toxicity.Linear(rows, np.zeros((300, 0)), y)) + 2e-3


def test_the_cut_between_two_groups():
    y = np.array([0, 0, 0, 1, 1, 0, 1.0])
    p = np.array([0.01, 0.02, 0.05, 0.4, 0.6, 0.03, 0.9])
    assert 0.05 < toxicity.best_cut(p, y) < 0.4
    assert toxicity.best_cut(p, np.zeros(7)) == 0.5 and toxicity.best_cut(np.zeros(0), np.zeros(0)) == 0.5
    mixed = toxicity.best_cut(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1.0]))
    assert 0.3 < mixed < 0.4  # a wrong rejection weighs more than a miss


def test_repeated_ids_and_long_texts_fit_alike(spark):
    docs, labels = corpus(200, 5)
    docs += [(3, "another text of the same id"), (3, "idiotic"), (3, None), (7, docs[7][1]), (1000, "scumbag " * 2000)]
    labels = spark.createDataFrame([*labels, (1000, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    fits = [toxicity.fit(spark.createDataFrame(some, "doc_id long, text string").repartition(n), labels, sample_bytes=10_000) for some, n in ((docs, 1), (docs[::-1], 5))]
    assert fits[0].held_out.tolist() == fits[1].held_out.tolist() and fits[0].reject == fits[1].reject
    assert 4 < len(fits[0].held_out) < 200


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    assert toxicity.score(docs, chain).count() == docs.count()
    assert toxicity.kept_rows(docs, chain).columns == docs.columns
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("rejected").count() == 0
    assert toxicity.score(empty_documents(spark), nothing).collect() == []
