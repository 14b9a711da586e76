import random

import pytest
from pyspark.sql import functions as F

from veilspark.llm import licences

from .helpers import duck, empty_documents, named, odd_documents

DOCS = [
    (0, "Released under the MIT License.\nbody text", "a"), (1, "plain text", "a"), (60, "plain", "a"), (1001, "no licence", "a"),
    (2, "intro\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.", "a"), (3, None, "b"), (4, "", None),
    (51, "Licensed under CC BY-NC 4.0.", "b"), (52, "the license of the poet is permitted use", "b"), (2051, "All rights reserved.", "b"),
    (54, "// Licensed under the Apache\n// License, Version 2.0.\n\nint main() {}", "c"), (55, "This file is released under the MIT License.", "d"),
    (56, "Copyright 2020 Acme. Released under the MIT License.", "d"), (57, "Released under the MIT License.\n\n\t\n\nsecond\nparagraph", None),
    (53, "This work is licensed under the GNU General Public License, version 3.", "b"), (58, "licensed under the mit license", "b"),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)


def scanned(df):
    return licences.scan(df, path=licences.placed())


def test_against_sql(spark):
    df = docs(spark)
    assert named(scanned(df)) == duck(licences.OP5_SQL, documents=df)


def test_lines_and_inheritance(spark):
    got = {r.doc_id: r for r in scanned(docs(spark)).collect()}
    assert (got[0].own_licence, got[2].own_licence, got[2].n_lines, got[53].own_licence, got[58].own_licence) == ("MIT", "Apache-2.0", 2, "GPL-3.0", "MIT")
    assert got[1].licence == "MIT" and got[1].inherited_from == "a/0/0" and got[60].licence is None
    assert (got[54].own_licence, got[54].n_lines, got[54].n_blocks) == ("Apache-2.0", 0, 1)
    assert got[52].own_licence is None and got[52].licence == "CC-BY-NC-4.0"


def test_the_nearest_directory_wins(spark):
    dirs = spark.createDataFrame([("",), ("a",), ("a/b",), ("a/b/c",), ("x/y",), ("ab",)], "directory string")
    files = spark.createDataFrame([("", "R"), ("a", "A"), ("a/b", "B")], "directory string, file_licence string")
    got = {r.directory: (r.file_licence, r["from"]) for r in licences.inherited(dirs, files).collect()}
    assert got == {"": ("R", ""), "a": ("A", "a"), "a/b": ("B", "a/b"), "a/b/c": ("B", "a/b"), "x/y": ("R", ""), "ab": ("R", "")}


def test_a_notice_in_a_source_file_holds_for_that_file_alone(spark):
    mit = dict(licences.licence_texts())["MIT"]
    notice = "Licensed under the Apache License, Version 2.0.\nint main() {}"
    rows = [(1, notice, "a/vendor_snippet.c"), (3, mit, "a/LICENSE"), (4, "code", "a/b/c.py"), (5, notice, "x/first.c"), (6, "code", "x/second.c")]
    rows += [(7, "Released under the MIT License.", "y/Copying.txt"), (8, "code", "y/z/q.c"), (9, mit, "w/0001.dat"), (10, "code", "w/c.c"), (11, notice, "w/NOTICE"), (12, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.licence, r.inherited_from) for r in licences.scan(df).collect()}
    assert got[1] == ("Apache-2.0", None) and got[4] == ("MIT", "a") and got[6] == (None, None) and got[12] == (None, None)
    assert got[8] == ("MIT", "y") and got[10] == ("Apache-2.0", "w") and got[9] == ("MIT", None)


def test_names_of_licence_files(spark):
    names = ["LICENSE", "licence.txt", "COPYING", "Copying.LESSER", "NOTICE.md", "UNLICENSE", "LICENSE-MIT", "license_apache", "licensed.c", "notices.py", "my-license", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(F.col("n").rlike(licences.FILE_NAME)).collect()
    assert [r[0] for r in got] == [True] * 8 + [False] * 4


def test_odd_rows(spark):
    df = odd_documents(spark)
    got = scanned(df)
    assert got.count() == df.count() and got.where("licence IS NOT NULL").count() == 0
    assert scanned(empty_documents(spark)).collect() == []


def test_scores_are_cosines(spark):
    got = {r.doc_id: r.own_score for r in scanned(docs(spark)).collect() if r.own_score}
    assert got[0] == pytest.approx(1.0) and all(0.8 <= s <= 1.000001 for s in got.values())


WHOLE = ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MIT", "MPL-2.0")


def licence_files(spark):
    """A licence file of each kind, wrapped anew, with an owner in front and some words lost; beside it a file without licence."""
    rng, texts, rows = random.Random(2), dict(licences.licence_texts()), []
    for i, name in enumerate(WHOLE):
        words = [w for w in texts[name].split() if rng.random() > 0.03]
        lines = [" ".join(words[k : k + 17]) for k in range(0, len(words), 17)]
        text = "Copyright (c) 2021 Some Owner\n\n" + "\n".join(lines[: len(lines) // 2]) + "\n\n" + "\n".join(lines[len(lines) // 2 :])
        rows += [(100 * i, text, name), (100 * i + 1, "a file that says nothing of it", name)]
    plain = "it is of the and a work or in to any that may be by this such which with as for not you if other all are".split()
    rows += [(1000 + i, " ".join(rng.choices(plain, k=400)), "plain") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_whole_licence_texts_are_recognised_and_inherited(spark):
    df = licence_files(spark)
    got = {r.doc_id: r for r in scanned(df).collect()}
    for i, name in enumerate(WHOLE):
        assert got[100 * i].own_licence == name and got[100 * i].n_blocks >= 1
        assert got[100 * i + 1].own_licence is None and got[100 * i + 1].licence == name
    assert all(got[1000 + i].licence is None for i in range(20))
    assert named(scanned(df)) == duck(licences.OP5_SQL, documents=df)


def test_common_words_beside_a_notice_cost_little_in_a_large_corpus(spark):
    plain = [(10_000 + i, "this file is of the plain sort and says so", "z") for i in range(400)]
    df = spark.createDataFrame(DOCS + plain, "doc_id long, text string, source string")
    got = {r.doc_id: r.own_licence for r in scanned(df).collect()}
    assert got[55] == "MIT"
