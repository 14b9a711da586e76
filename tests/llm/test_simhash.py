import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import common, simhash
from veilspark.llm.common import components

from .helpers import empty_documents, odd_documents, rows


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if len(words) >= n else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, links):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_close_pairs_against_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for _ in range(300)], np.uint64)
    lo, hi = np.arange(1, 301), np.full(300, 300)
    hi[50:60] = 55
    wide = np.stack([fp, simhash.mixed(fp)], axis=1)
    for radius in (0, 9, 40):
        a, b = simhash.close_pairs(wide, lo, hi, radius)
        distance = np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2)
        assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(300) for j in range(lo[i], hi[i]) if distance[i, j] <= radius}
    for radius in (0, 1, 2, 3, 5):
        a, b = simhash.close_pairs(fp, lo, hi, radius)
        want = {(i, j) for i in range(300) for j in range(lo[i], hi[i]) if bin(int(fp[i]) ^ int(fp[j])).count("1") <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_links_connect_what_brute_force_connects_even_in_pieces(spark):
    random.seed(3)
    values = {random.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(random.randrange(8)):
            values.add(v ^ sum(1 << b for b in random.sample(range(64), random.randrange(1, 5))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    close = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    want = roots(signed, close)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for piece in (4096, 3):
        got = [(r.u, r.v) for r in simhash.links(df, 3, piece).collect()]
        assert roots(signed, got) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}


def test_components_of_few_edges_are_few_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "u long, v long"))
        assert found.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.root for r in found.collect()} == {2: 1, 3: 1, 9: 8}


def test_fingerprints_are_exact_and_copies_link(spark):
    docs = odd_documents(spark)
    found = simhash.near_duplicates(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1) for r in found if r.doc_id is not None) == sorted((r.doc_id, plain_fingerprint(r.text)) for r in texts if r.doc_id is not None)
    by_id = {r.doc_id: r.component_id for r in found}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[6] == by_id[7] == 6 and len(found) == docs.count()


def test_one_of_alike_stays(spark):
    docs = odd_documents(spark)
    kept = simhash.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 3, 4, 5, 6, 8, 9, 10, 11]
    assert kept.where(F.col("doc_id").isNull()).count() == 1


def test_no_rows(spark):
    assert rows(simhash.near_duplicates(empty_documents(spark))) == []
    assert rows(simhash.kept_rows(empty_documents(spark))) == []


def test_similar_sets_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choice(words) for _ in range(12))
    texts = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice((3, 7, 40, 150, 600)))]
        texts.append(" ".join(base) + (" " + shared if i % 2 else ""))
        for k in range(rng.randrange(4)):
            copy = base[:]
            for _ in range(rng.randrange(1, 2 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + (" " + shared if i % 2 else ""))
    texts += [None, "", "  ", texts[0].upper()]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    n = range(len(texts))
    pairs = [(i, j) for i in n for j in n if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    bits = [int(simhash.set_fingerprint(simhash.shingle_set(t, 5))[0]) for t in texts]
    assert sum((bits[i] ^ bits[j]).bit_count() > 3 for i, j in pairs) > 10  # what three bits leave
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {v for v, root in roots(n, pairs).items() if v == root}
    for piece, at_once in ((simhash.PIECE, simhash.PAIRS), (2, 5)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "PAIRS", at_once)
        monkeypatch.setattr(simhash, "SETS", piece)
        assert sorted(r.doc_id for r in simhash.kept_of_similar(docs).collect()) == sorted(want)


def test_many_near_copies_of_one_text_are_compared_with_few(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(base)]
    for i in range(400):
        copy = base[:]
        for _ in range(3):
            copy[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    seen = []
    real = simhash.alike
    try:
        simhash.alike = lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest)
        assert [r.doc_id for r in simhash.kept_of_similar(docs).collect()] == [0]
    finally:
        simhash.alike = real
    assert sum(seen) < 4 * 400


def test_similar_odd_rows(spark):
    df = odd_documents(spark)
    got = simhash.kept_of_similar(df)
    assert got.columns == df.columns and got.count() == simhash.kept_rows(df, radius=0).count()
    assert simhash.kept_of_similar(empty_documents(spark)).collect() == []


def test_a_star_is_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 1000)
    star = spark.range(1, 30_000, 1, 8).selectExpr("0L AS u", "id AS v")
    both = star.union(star.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = common.joined_once(both, low, "u")
    assert joined.count() == 2 * 29_999
    hub = joined.where("u = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(hub) >= 8 and max(r["count"] for r in hub) < 29_999 / 4
    assert components(star).groupBy("root").count().collect()[0]["count"] == 29_999
    docs = spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("one text for all of them").alias("text"))
    assert simhash.near_duplicates(docs).groupBy("component_id").count().collect() == [(0, 3000)]
