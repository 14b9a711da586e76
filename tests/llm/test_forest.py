import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import forest

from .helpers import duck, empty_documents, named, odd_documents, rows
from .test_simhash import roots


def plain_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, percent=85):
    """(id, shingles, component, kept) of (id, text), by comparing all pairs."""
    sets = [plain_set(t) for _, t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root, low = roots(list(range(len(docs))), near), {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[root[k]] = min(i, low.get(root[k], i))
    return sorted(((i, len(sets[k]), low.get(root[k]), i == low.get(root[k])) for k, (i, _) in enumerate(docs)), key=str)


def families(seed, count=30):
    """Texts of some length, each with copies that have a few words changed, and a passage that many of them hold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(count):
        base = [word() for _ in range(rng.randrange(5, 400))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, dense, piece, sets", [(1, 256, 4096, 1024), (2, 4, 8, 5)])
def test_against_all_pairs_even_where_regions_are_cut(spark, monkeypatch, seed, dense, piece, sets):
    for name, value in (("DENSE", dense), ("PIECE", piece), ("SETS", sets)):
        monkeypatch.setattr(forest, name, value)
    docs = families(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(forest.near_duplicates(df)) == brute(docs)


def test_a_family_at_the_threshold(spark):
    # Copies of one text that lie about the threshold from each other: many pairs, of which some link.
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    docs = []
    for i in range(150):
        copy = list(base)
        for _ in range(5):
            copy[rng.randrange(300)] = f"x{rng.random()}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(forest.near_duplicates(df)) == brute(docs)


def test_odd_rows_against_sql(spark):
    docs = odd_documents(spark)
    got = forest.near_duplicates(docs)
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    ours = {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()}
    assert ours == {(i, n, c if n else i) for i, n, c, _ in brute(plain)}
    assert named(got) == duck(forest.OP11_SQL, documents=docs)
    assert rows(forest.near_duplicates(empty_documents(spark))) == []
    kept = forest.kept_rows(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id = 6").count() == 1


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(4)
    shares = []
    for _ in range(200):
        both, one, two = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (850, 75, 75))
        left, right = (forest.paths_of(np.r_[both, x]) for x in (one, two))
        shares.append(int(forest.agreeing(left, right)))
    assert abs(np.mean(shares) - 132.6) < 1.5 and min(shares) >= forest.AGREE


def test_least_words_are_one_shingle():
    assert len(forest.shingles("A b c")) == 1 and (forest.shingles("A b c") == forest.shingles("a  B\nc")).all()
    assert len(forest.shingles(" \n")) == len(forest.shingles(None)) == 0
    text = " ".join(map(str, range(200_000)))
    assert len(forest.shingles(text)) == 199_996
