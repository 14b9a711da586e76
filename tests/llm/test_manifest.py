import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm import common, manifest

from .helpers import duck, empty_documents, named, odd_documents, rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, at, fanout):
    """The top of a list of digests, and what stands before and after node ``at`` on its way there."""
    path = []
    while len(nodes) > 1:
        first = at // fanout * fanout
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at //= fanout
    return nodes[0], path


def brute(docs, fanout=16):
    """Rows of (id, source, lang, n_chars, text): id, leaf, subroot, root, proof, folded root, verified."""
    groups = {}
    for r in docs:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tops = [climb([leaf(r) for r in groups[s]], 0, fanout)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        root, above = climb(tops, k, fanout)
        leaves = [leaf(r) for r in groups[s]]
        for i, r in enumerate(groups[s]):
            path = climb(leaves, i, fanout)[1] + above
            now = leaves[i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                now = sha(a, now, b)
            out.append((r[0], leaves[i], tops[k], root, sha(*(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("count, sources, fanout", [(1, 1, 16), (16, 1, 16), (17, 1, 16), (700, 40, 16), (400, 3, 2), (90, 90, 3)])
def test_against_plain_trees(spark, count, sources, fanout):
    rng = random.Random(count)
    docs = [(i, rng.choice([None, *(f"s{k}é" for k in range(sources - 1))]), "en", rng.choice([None, 3]), rng.choice([None, "", "Abc É", f"Text {i}"])) for i in range(count)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    changed = {"text": manifest.tampered(F.col("doc_id"), F.col("text"))}
    assert rows(manifest.verified_rows(df, changed, fanout=fanout).select(*NAMES)) == brute(docs, fanout)


def test_odd_rows_against_sql_and_plain_trees(spark):
    docs = odd_documents(spark)
    changed = {"text": manifest.tampered(F.col("doc_id"), F.col("text"))}
    got = manifest.verified_rows(docs, changed).select(*NAMES)
    assert rows(got) == brute([tuple(r) for r in docs.select(*manifest.COLUMNS).collect()])
    assert named(got) == duck(manifest.OP13_SQL, documents=docs)


def test_no_rows(spark):
    assert rows(manifest.verified_rows(empty_documents(spark), {})) == []


def test_only_what_was_changed_fails(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"text {i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.verified_rows(docs, {"n_chars": F.when(F.col("doc_id") == 17, 2).otherwise(F.col("n_chars"))})
    assert [r.doc_id for r in got.where("NOT verified").collect()] == [17]


def test_numbers_count_a_group_in_order(spark):
    df = spark.createDataFrame([(f"g{i % 3 // 2}", i * 7919 % 1000) for i in range(1000)], "g string, x long").repartition(6)
    for r in common.numbered(df, "g", ["x"]).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("x", "idx"))).alias("a"), F.max("n").alias("n")).collect():
        assert [x.idx for x in r.a] == list(range(r.n)) and len(r.a) == r.n
