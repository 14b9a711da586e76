import math
from collections import Counter

import numpy as np
import pytest

from veilspark.operators import language

SF = "/root/testdata/sf0.001"


def plain(text):
    """Triples of a lower-cased text."""
    t = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text)
    t = f" {' '.join(x for x in t.split(' ') if x)} "
    return [((ord(a) * 1000003 + ord(b)) * 1000003 + ord(c)) % (1 << 15) for a, b, c in zip(t, t[1:], t[2:])] if t.strip() else []


@pytest.mark.parametrize("text", ["", "   ", "a", "ab c", "12 é", "x" * 9, "one, two;  three\n\tfour", "مرحبا hi", "z z"])
@pytest.mark.parametrize("block", [1, 2, 3, 1 << 20])
def test_triples_whatever_the_blocks(monkeypatch, text, block):
    monkeypatch.setattr(language, "BLOCK", block)
    assert [int(x) for found in language.triples(text) for x in found] == plain(text)
    assert list(language.triples(None)) == []


def test_against_plain_counting(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "der Hund", None), (5, "the hat", "en"), (6, "", "en"), (None, "le the", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(df)
    counts = {la: Counter(x for _, t, other in rows if other == la and t for x in plain(t.lower())) for la in ("en", "fr")}
    assert model.names == ("en", "fr") and [[int(n) for n in row[row > 0]] for row in model.counts] == [[counts[la][b] for b in sorted(counts[la])] for la in model.names]
    for r in language.identified(df, model).collect():
        sums = {la: sum(math.floor(1000 * math.log((counts[la][b] + 1) / (sum(counts[la].values()) + language.BUCKETS))) for b in plain((r.text or "").lower())) for la in model.names}
        best = max(sorted(sums), key=sums.get)
        assert (r.language, r.score, r.margin) == ((best, sums[best], sums[best] - min(sums.values())) if r.text else ("en", 0, 0))
    again = language.model_of(model.rows(spark))
    assert again.names == model.names and np.array_equal(again.counts, model.counts)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "some text", "x", "clash"), (2, None, None, None)], "doc_id long, text string, language string, `a b` string")
    none = language.model_of(spark.createDataFrame([], "lang string, bucket long, n long"))
    got = language.identified(df.drop("language"), none)
    assert got.columns == ["doc_id", "text", "a b", "language", "score", "margin"] and {r.language for r in got.collect()} == {"en"}
    assert language.identified(df.limit(0), none).count() == 0
    one = language.fit(df, lang_col="language")
    assert [(r.language, r.margin) for r in language.identified(df.drop("language"), one).orderBy("doc_id").collect()] == [("x", 0), ("en", 0)]


def test_languages_are_told_apart_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.held_out(docs).collect()
    right = {la: sum(r.n for r in got if r.lang == la == r.language) / sum(r.n for r in got if r.lang == la) for la in {r.lang for r in got}}
    assert len(right) == 4 and min(right.values()) >= 0.97, right


def test_routes_follow_the_language(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ar",), ("en",), ("fr",)], "language string")
    assert [r[0] for r in df.select(language.route_language(F.col("language"))).collect()] == ["ar", "en", "en"]


def test_only_kept_columns_go_with_the_text(spark):
    rows = spark.createDataFrame([(1, "the cat sat", "x")], "doc_id long, text string, more string")
    model = language.fit(spark.createDataFrame([("the cat", "en")], "text string, lang string"))
    whole, slim = language.identified(rows, model), language.identified(rows, model, keep=["doc_id"])
    assert slim.columns == ["doc_id", "language", "score", "margin"]
    assert slim.first() == whole.drop("text", "more").first()


def test_a_long_text_is_counted_in_small_blocks():
    import tracemalloc

    text = "of some words " * 150_000
    tracemalloc.start()
    n = sum(len(x) for x in language.triples(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) - 1 and peak < 10_000_000
