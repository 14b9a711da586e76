import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from veilspark.llm import resample

from .helpers import duck, empty_documents, named, odd_documents, rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20):
    """(id, features, weight, score, rank) of (id, text) rows, by plain counting."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, n)[0]))
    for text in target:
        t.update(map(bucket, features(text, n)[0]))
    of_s, of_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (of_s + buckets) / ((s[b] + 1) * (of_t + buckets))))
    out = []
    for i, text in docs:
        found, words = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = {id(x): k + 1 for k, x in enumerate(order[: percent * len(order) // 100])}
    return sorted(((*x[:4], drawn.get(id(x))) for x in out), key=str)


def some(seed, count=400):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["É", "naïve", "ÀB", "don't", "x-y", "日本"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 19, 20, 21, 60, 400])))) for i in range(count)]
    return docs, [" ".join(rng.choices(vocab[:80], k=30)) for _ in range(20)]


@pytest.mark.parametrize("n, chunk", [(1, 1 << 16), (2, 64), (3, 17)])
def test_against_plain_counting_whatever_the_chunks(spark, n, chunk):
    docs, target = some(n)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, wanted, n=n, chunk=chunk, percent=25)
    assert rows(got.select("doc_id", "n_features", "weight", "score", "rank")) == brute(docs, target, n, percent=25)


def test_chunks_own_each_feature_once():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("aB0é  .\n") for _ in range(rng.randrange(0, 120)))
        for n in (1, 2, 4):
            whole, words = features(text, n)
            found = []
            size = rng.randrange(1, 30)
            for part, owned in resample.chunks_of(text, n, size):
                mine = part.decode().split()
                assert owned <= len(mine) <= owned + n - 1
                found += [" ".join(mine[i : i + k]) for k in range(1, n + 1) for i in range(min(owned, len(mine) - k + 1))]
            assert Counter(found) == Counter(whole)


def test_odd_rows_against_sql(spark):
    docs, target = odd_documents(spark), spark.createDataFrame([(1, "the cat sat"), (2, None), (None, "")], "item_id long, text string")
    got = resample.resample(docs, target, percent=10).drop("n_words")
    assert named(got) == duck(resample.OP12_SQL, documents=docs, benchmark=target)
    # Long texts in small chunks, repeated rows too, come to the same.
    assert rows(resample.resample(docs, target, chunk=50).drop("n_words")) == rows(got)
    assert resample.drawn_rows(docs, target, percent=50).columns == docs.columns


def test_no_rows(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert rows(resample.resample(empty_documents(spark), target)) == []
    assert rows(resample.resample(empty_documents(spark), target.limit(0))) == []
    docs = spark.createDataFrame([(1, "only a few words")], "doc_id long, text string")
    (r,) = resample.resample(docs, target.limit(0)).collect()
    assert (r.n_features, r.rank) == (4, None)


def test_equal_scores_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(None, "a b c d")] * 30 + [(7, "a b c d")] * 30, "doc_id long, text string")
    got = resample.resample(docs, docs.select("text"), least_words=1, percent=50).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 31)) and len({r.score for r in got}) == 1
