import random

import numpy as np

from veilspark.llm import packing
from veilspark.llm.common import work_dir

from .helpers import empty_documents, odd_documents


def plain_best_fit(lengths, width):
    rows, placed = [], {}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = [r for r in range(len(rows)) if rows[r] >= lengths[i]]
        if not fit:
            rows.append(width)
            fit = [len(rows) - 1]
        best = min(rows[r] for r in fit)
        placed[i] = best
        rows[next(r for r in fit if rows[r] == best)] -= lengths[i]
    return len(rows), sorted(rows)


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for _ in range(50):
        width = rng.choice([1, 7, 64, 100])
        lengths = [rng.randrange(1, width + 1) for _ in range(rng.randrange(80))]
        placed, n = packing.best_fit_decreasing(lengths, width)
        used = {}
        for (row, start), length in zip(placed, lengths):
            cells = set(range(start, start + length))
            assert start + length <= width and not cells & used.setdefault(row, set())
            used[row] |= cells
        want_n, want_free = plain_best_fit(lengths, width)
        assert n == want_n and sorted(width - len(used[r]) for r in used) == want_free


def test_round_trip(spark):
    docs = odd_documents(spark)
    folder = work_dir(spark, "packed")
    got = packing.pack(docs, folder, width=64, shard_tokens=500).collect()
    with open(packing.VOCABULARY, "rb") as f:
        enc = packing.encoder(f.read(), packing.PATTERN)
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, r.text or "")
    shards = {n: packing.read_shard(folder, n) for n in {r.shard for r in got} if n}
    for r in got:
        ids = [x for p in r.pieces for x in shards[r.shard]["ids"][p.row, p.start : p.start + p.length].tolist()]
        assert enc.decode(ids[:-1]) == texts[r.doc_id] and len(ids) == (r.n_tokens + 1 if r.n_tokens else 0)
        assert all(p.length == 64 for p in r.pieces[:-1])
    assert len(got) == docs.count()
    for s in shards.values():
        resets = np.unpackbits(s["resets"], axis=1)[:, :64].astype(bool)
        for row in range(len(s["ids"])):
            cu = s["cu_seqlens"][s["row_ptr"][row] : s["row_ptr"][row + 1]]
            assert cu[0] == 0 and (np.diff(cu) > 0).all() and np.flatnonzero(resets[row]).tolist() == cu[:-1].tolist()
            assert (s["ids"][row, cu[-1] :] == packing.END).all()


def test_no_rows(spark):
    assert packing.pack(empty_documents(spark), work_dir(spark, "packed")).collect() == []


def test_a_second_attempt_in_another_order_names_its_own_shards(spark):
    folder = work_dir(spark, "packed")
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 9)) for i in range(60)], "doc_id long, text string")
    packing.pack(docs.coalesce(1), folder, width=16, shard_tokens=100).collect()  # what a lost attempt left
    got = packing.pack(docs.orderBy(docs.doc_id.desc()).coalesce(1), folder, width=16, shard_tokens=100).collect()
    with open(packing.VOCABULARY, "rb") as f:
        enc = packing.encoder(f.read(), packing.PATTERN)
    shards = {n: packing.read_shard(folder, n) for n in {r.shard for r in got} if n}
    for r in got:
        ids = [x for p in r.pieces for x in shards[r.shard]["ids"][p.row, p.start : p.start + p.length].tolist()]
        assert enc.decode(ids[:-1]) == f"text number {r.doc_id} " * (r.doc_id % 9)
