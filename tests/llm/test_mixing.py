import random

import pytest

from veilspark.llm import mixing

from .helpers import duck, empty_documents, named, odd_documents, rows


def poured(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by pouring the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while rest > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        add = {s: rest * w[s] / total for s in open_}
        rest = 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] >= cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 5, 100, 10**6, rng.randrange(1, 5000)]) for s in [None, *map(str, range(rng.randrange(1, 14))), "é", "Z", ""]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(poured(sizes), rel=1e-9, abs=1e-6)


def test_odd_rows_against_sql(spark):
    docs = odd_documents(spark)
    got = mixing.mix(docs).drop("source")
    assert named(got) == duck(mixing.OP8_SQL, documents=docs)
    assert rows(mixing.mix(empty_documents(spark))) == [] and rows(mixing.mixed_rows(empty_documents(spark))) == []


def test_every_source_comes_to_its_target_and_reruns_agree(spark):
    rng = random.Random(3)
    docs = [(i, "w " * rng.randrange(0, 90), f"s{0 if rng.random() < 0.4 else rng.randrange(6)}") for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert rows(mixing.mix(df.repartition(7))) == rows(mixing.mix(df))
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target + 1e-9) and all(0 <= r.taken <= 2 * r.size for r in mine)


def test_the_mix_itself_has_the_words_taken(spark):
    docs = odd_documents(spark)
    mixed = mixing.mixed_rows(docs)
    words = lambda df: sum(len((r.text or "").encode().split()) for r in df.collect())
    assert mixed.columns == docs.columns
    assert words(mixed) == sum(r.taken for r in mixing.mix(docs).collect())


def test_many_rows_that_nothing_tells_apart(spark):
    rows_ = [(None, "a b c", "s0")] * 3000 + [(7, "x " * (i % 5), "s0") for i in range(2000)] + [(i, "w w", "s1") for i in range(50)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).drop("source")
    assert named(got) == duck(mixing.OP8_SQL, documents=docs)


def test_copies_of_a_row_are_made_in_pieces(spark, monkeypatch):
    from veilspark.llm import common

    monkeypatch.setattr(common, "PIECE", 7), monkeypatch.setattr(mixing, "PIECE", 7)
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 8), ("e", 50)], "k string, m long")
    got = common.copied(df, df["m"], "i", ["k"])
    assert rows(got.select("k", "i")) == sorted(((k, i) for k, m in df.collect() for i in range(m)), key=str)
    alike = [(None, "", "s0")] * 500 + [(None, "a b c", "s1")] * 300 + [(i, "w " * (i % 5), "s0") for i in range(40)]
    docs = spark.createDataFrame(alike, "doc_id long, text string, source string").repartition(5)
    assert named(mixing.mix(docs).drop("source")) == duck(mixing.OP8_SQL, documents=docs)
    mixed = mixing.mixed_rows(docs)
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in mixed.collect()) == taken
    assert mixed.where("text = 'a b c'").count() > 290
