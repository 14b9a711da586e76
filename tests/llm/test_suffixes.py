import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import suffixes

from .helpers import empty_documents, odd_documents


def brute(texts, length=suffixes.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), [(a, z + 1) for a, z in suffixes.runs(gone)], hashlib.sha256(kept).hexdigest()))
    return out


def test_the_cover_meets_every_pair():
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            d = suffixes.MEET[a, b]
            assert (a + d) % suffixes.PERIOD in suffixes.COVER and (b + d) % suffixes.PERIOD in suffixes.COVER


@pytest.mark.parametrize("seed", range(12))
def test_block_sorting_against_counting(seed):
    rng = random.Random(seed)
    length = rng.choice([64, 200])
    base = bytes(rng.choice(b"ab") for _ in range(rng.choice([3, 50, 400])))
    t = b"".join(base[rng.randrange(len(base)) :] if rng.random() < 0.7 else bytes(rng.choice(b"abc") for _ in range(30)) for _ in range(30))
    t = t if len(t) > length + 5 else t * 10 + b"x" * length
    starts = np.array(sorted(rng.sample(range(len(t) - length + 1), min(len(t) - length + 1, 700))))
    seen = Counter(t[s : s + length] for s in starts.tolist())
    got = suffixes.repeated(np.frombuffer(t, np.uint8), starts, length)
    assert got.tolist() == [seen[t[s : s + length]] > 1 for s in starts.tolist()]


@pytest.mark.parametrize("most, block, least", [(2, 500, 2), (5000, 1 << 21, 1024), (3, 1 << 21, 5), (5000, 500, 3)])
def test_texts_against_brute_force(spark, monkeypatch, most, block, least):
    monkeypatch.setattr(suffixes, "SORTED_BYTES", 2000)
    rng = random.Random(4)
    piece = lambda n, of="abc": "".join(rng.choice(of) for _ in range(n))
    common = piece(450, "abcdef ")
    texts = [None, "", "a" * 1000, "ab" * 700, "x" * 199, "y" * 200, "y" * 200, "z" * 201, "é" * 150]
    texts += ["é" * 100 + str(i) + "q" * 150 for i in range(5)]
    line = piece(180, "ghijkl ")  # shorter than a window, in many contexts
    texts += [piece(60) + line + piece(60) for _ in range(30)] + [piece(20) + common + line for _ in range(3)]
    texts += [piece(rng.randrange(300)) + common[rng.randrange(200) :] + piece(rng.randrange(300)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixes.deduplicate(docs, most=most, block=block, least=least).collect()}
    for i, (n, spans, digest) in enumerate(brute(texts)):
        r = got[i]
        assert (r.n_bytes, [(s.start, s.end) for s in r.removed], hashlib.sha256(r.kept).hexdigest()) == (n, spans, digest)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = suffixes.deduplicate(docs).collect()
    assert len(got) == docs.count()
    assert all(r.kept == b"" for r in got if r.doc_id in (6, 7)) and all(r.removed == [] for r in got if r.doc_id in (0, 3, 5))
    assert suffixes.deduplicate(empty_documents(spark)).collect() == []


def test_a_text_longer_than_a_chunk(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    docs = spark.createDataFrame([(1, text), (2, "x" + text[2900:3300]), (3, text[10:400])], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in suffixes.deduplicate(docs).collect()}
    assert got == {1: [(10, 400), (2900, 3300)], 2: [(1, 401)], 3: [(0, 390)]}


def test_one_gram_in_ten_thousand_windows(spark):
    rng = random.Random(3)
    line = "this line of some length stands in every text, and more than once at that"
    own = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(40, 160)))
    texts = ["".join(own() + line for _ in range(10)) for _ in range(1100)] + ["ab" * 6000]
    texts += [texts[0][50:900], texts[3][:400] + texts[4][-400:]]
    assert sum(t.count(line[:32]) for t in texts) > 10_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    got = {r.doc_id: r for r in suffixes.deduplicate(docs, most=64, block=3000).collect()}
    for i, (n, spans, digest) in enumerate(brute(texts)):
        assert (got[i].n_bytes, [(s.start, s.end) for s in got[i].removed], hashlib.sha256(got[i].kept).hexdigest()) == (n, spans, digest)


def test_frequent_grams_rank_last_and_change_nothing():
    rng = np.random.default_rng(1)
    t = rng.choice(np.frombuffer(b"abcd", np.uint8), 5000)
    h = suffixes.gram_hashes(t)
    plain = suffixes.minimisers(t, np.array([5000]))
    often = np.sort(plain[0][plain[0] < suffixes.LOW])
    again = suffixes.minimisers(t, np.array([5000]), often=often)
    assert not np.isin(again[0], often).any() and np.isin(again[0], h).all()
    assert sum(z - a + 1 for a, z in zip(*again[2:])) == 5000 - suffixes.LENGTH + 1


def periodic(size):
    return (b"na " * (size // 3 + 1))[:size]


def test_a_long_periodic_text_stays_small():
    """Twenty MB through all steps of the workers: what they hold beside the text is bounded."""
    text = periodic(20_000_000)
    k = hashlib.sha256(text).digest()[:16]
    batch = pa.RecordBatch.from_arrays([pa.array([k]), pa.array([text], pa.binary())], names=["k", "b"])
    often = next(suffixes.counted(iter([pa.RecordBatch.from_arrays([batch.column(1)], names=["b"])]), suffixes.LENGTH))
    grams = np.sort(np.array([g for g in often.column(0).to_pylist() if g is not None], np.int64).view(np.uint64))
    tracemalloc.start()
    found = list(suffixes.occurrences(iter([batch]), suffixes.LENGTH, lambda: grams))
    runs = pa.Table.from_batches(found).select(["run", "bucket", "gram"]).combine_chunks().to_batches()[0]
    assert len(runs) < 2000
    lists = pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), pa.StructArray.from_arrays(runs.columns, names=runs.schema.names))
    rows = list(suffixes.with_text(iter([pa.RecordBatch.from_arrays([*batch.columns, lists], names=["k", "b", "runs"])]), suffixes.LENGTH))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spans = [(a, e) for b in rows for t, a, e in zip(*(b.column(i).to_pylist() for i in (1, 4, 5))) if t == 3]
    assert min(a for a, _ in spans) == 0 and max(e for _, e in spans) == len(text) and peak < 100_000_000
