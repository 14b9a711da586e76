"""Licence scans, in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along directories.

Units of documents are compared with licence notices, file headers and whole licence texts: every line; every paragraph of
several lines, so that a wrapped notice or a comment block is one unit; and, if it has several paragraphs, the whole document. Weights
are TF-IDF, with document frequencies counted over all documents for every term. Which units can reach the threshold at all
is known beforehand: of each template the terms that are rarest in the documents are anchors, so many that what is left of it falls short of the
threshold by itself. Only units with an anchor are looked at, and of these only those whose terms in common with a
template could reach the threshold if there were nothing else; nothing is lost by that. Texts are read twice, once to count
terms and once to take such units out.

A directory's licence file is a document that is named so, as LICENSE or COPYING.md, and has a licence, or one that is a licence text as a
whole. A notice in any other file holds for that file alone. Documents without a
licence of their own inherit from the nearest directory above them that has a licence file: every directory is joined with the paths of
its ancestors, and the longest match wins.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import checkpoint, table, written

THRESHOLD = 0.8
#: Of a template's squared length what its light terms may have; a unit is held against the heavy ones first.
LIGHT = 0.2
#: Short notices by SPDX identifier. A template may have several.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("All-Rights-Reserved", "All rights reserved."),
)
#: The headers that licences ask for in source files.
HEADERS = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)


def licence_texts() -> tuple[tuple[str, str], ...]:
    """(SPDX identifier, text) of the whole licence texts beside this module, read on the driver."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return tuple((f.stem, f.read_text("utf-8")) for f in files)


TEMPLATES = NOTICES + HEADERS + licence_texts()
#: Base names of licence files, with any extension.
FILE_NAME = r"(?i)^(un)?licen[sc]e([.\-_].*)?$|^copying([.\-_].*)?$|^notice([.\-_].*)?$"
TERM = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
#: What parts paragraphs: line ends with nothing but white space between them.
GAP = r"\n[\x09-\x0D\x20]*\n"


def terms(text: Column) -> Column:
    """The lower-cased terms of a text; inner dots and hyphens belong to a term."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): in how many of ``docs(text)`` each term is; the empty term is in all. Sums are partial before they travel."""
    every = F.concat(F.array(F.lit("")), F.array_distinct(terms(F.col("text"))))
    return docs.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def weighted_templates(counted: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(template, licence, total, term, weight, rest, common) of the templates' terms; weight is the share of a unit vector.

    ``rest`` is the squared length of a term and all lighter ones together, ``common`` that of it and all that more documents have, ``total`` the
    number of documents. The templates are few and fixed, so their terms are too.
    """
    rows = counted.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, licence string, notice string")
    rows = rows.select("template", "licence", F.explode(terms(F.col("notice"))).alias("term"))
    rows = rows.groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    known = counted.join(F.broadcast(rows.select("term").distinct()), "term", "left_semi")  # no more than the templates have
    total = counted.where("term = ''").select(F.col("n").alias("total"))  # one row
    rows = rows.join(F.broadcast(known), "term", "left").join(F.broadcast(total), F.lit(True), "left")
    rows = rows.withColumn("total", F.coalesce("total", F.lit(0)))
    rows = rows.withColumn("w", F.col("tf") * idf(F.col("total"), F.coalesce("n", F.lit(0))))
    ordered = F.sort_array(F.collect_list(F.struct("w", "term"))).alias("ts")
    rarer = F.sort_array(F.collect_list(F.struct(-F.coalesce("n", F.lit(0)), "w", "term"))).alias("rs")
    rows = rows.groupBy("template", "licence", "total").agg(ordered, rarer, F.sum(F.col("w") * F.col("w")).alias("square"))

    def share(some: Column) -> Column:
        return F.aggregate(some, F.lit(0.0), lambda a, y: a + y["w"] * y["w"]) / F.col("square")

    def weighed(x: Column, i: Column) -> Column:
        at = F.array_position(F.transform("rs", lambda y: y["term"]), x["term"]).cast("int")
        rest, common = share(F.slice("ts", F.lit(1), i + 1)), share(F.slice("rs", F.lit(1), at))
        return F.struct(x["term"].alias("term"), (x["w"] / F.sqrt("square")).alias("weight"), rest.alias("rest"), common.alias("common"))

    return rows.select("template", "licence", "total", F.explode(F.transform("ts", weighed)).alias("t")).select("template", "licence", "total", "t.*")


def idf(total: Column, n: Column) -> Column:
    return F.log((total + 1) / (n + 1)) + 1


def units(text: Column, heavy: list, threshold: float) -> Column:
    """The lines (kind 0), paragraphs of several lines (1) and the whole of several paragraphs (2) that may be like a template.

    ``heavy(template, term, weight, rest, common)`` are the heavier and the rarer terms of the templates, some rows of fixed lists.
    """
    least = threshold**2 - 1e-6
    anchors = F.lit(sorted({r.term for r in heavy if r.common >= least}))
    heavy = [r for r in heavy if r.rest > LIGHT]
    every = F.lit(sorted({r.term for r in heavy}))
    wanted = []
    for t in sorted({r.template for r in heavy}):
        mine = [r for r in heavy if r.template == t]
        parts = F.array(*(F.struct(F.lit(r.term).alias("term"), F.lit(r.weight**2).alias("square")) for r in mine))
        # What the terms that are not listed may add is at most this.
        light = 1 - sum(r.weight**2 for r in mine)
        wanted.append(F.struct(F.lit(least - light).alias("least"), parts.alias("parts")))
    wanted = F.array(*wanted)

    def near(u: Column, have: Column) -> Column:
        def reaches(common: Column) -> Column:
            add = lambda a, p: a + F.when(F.array_contains(common, p["term"]), p["square"]).otherwise(F.lit(0.0))
            return F.exists(wanted, lambda w: F.aggregate(w["parts"], F.lit(0.0), add) >= w["least"])

        return let(terms(u["text"]), lambda ts: F.arrays_overlap(ts, have) & let(F.array_intersect(ts, every), reaches))

    def some(texts: Column, kind: int, several: str | None, have: Column) -> Column:
        rows = F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), t.alias("text")))
        return F.filter(rows, lambda u: (u["text"].contains(several) if several else F.lit(True)) & near(u, have))

    paragraphs = F.split(text, GAP, -1)
    whole = F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<struct<kind:int,no:int,text:string>>")

    def found(have: Column) -> Column:
        each = F.concat(some(F.split(text, "\n", -1), 0, None, have), some(paragraphs, 1, "\n", have), some(whole, 2, None, have))
        return F.when(F.size(have) > 0, each).otherwise(none)

    # The anchors that a document has are few, and a line is held against these first.
    return let(F.array_intersect(terms(text), anchors), found)


def matches(found: DataFrame, templates: DataFrame, counted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, kind, no, template, licence, score) of units ``found(doc, kind, no, text)`` at ``threshold`` or above, the best for each."""
    unit, few = ["doc", "kind", "no"], F.broadcast(templates.select("template", "licence", "term", "weight"))
    parts = found.select(*unit, F.explode(terms(F.col("text"))).alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("tf"))
    parts = written(parts, "terms")  # of known size: the many terms of all documents do not travel to a few
    total = F.broadcast(templates.agg(F.max("total").alias("total")))  # one row
    parts = parts.join(counted, "term").join(total, F.lit(True), "left")
    parts = checkpoint(parts.withColumn("w", F.col("tf") * idf(F.col("total"), F.col("n"))).select(*unit, "term", "w"))
    norms = parts.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = parts.join(few, "term").groupBy(*unit, "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, unit).select(*unit, "template", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = F.max_by(F.struct("licence", "template", "score"), F.struct("score", -F.col("template"))).alias("b")
    return scored.where(F.col("score") >= threshold).groupBy(*unit).agg(best).select(*unit, "b.*")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: Column | None = None,
    templates: tuple = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, directory, own_licence, own_score, n_lines and n_blocks (lines, and paragraphs
    or the whole, that are a licence), licence, inherited_from (a directory, null if the licence is its own or there is none).

    ``path`` is a document's path, by default a column of that name; what follows its last slash is its name. A
    null path lies in the root, '', and has no name. Of several licences in a document the best counts, of equals a line, then a paragraph, then
    the first. A document named as a licence file gives its directory its licence, any other one only that of its whole text; of several in a
    directory those so named come first, then the smallest id, then the first licence by name. Null and
    empty texts have no licence but inherit. Very long texts are compared by line, by paragraph and as wholes like others.
    Rows alike in id, path and text are one document in several rows. Other columns are not read. Of no rows come no rows.
    """
    path = F.coalesce(F.col("path") if path is None else path, F.lit(""))
    where, name = F.regexp_replace(path, "/?[^/]*$", ""), F.regexp_extract(path, "[^/]*$", 0)
    src = docs.select(F.col(id_col).alias("doc_id"), where.alias("directory"), name.rlike(FILE_NAME).alias("named"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = checkpoint(document_frequencies(src))
    weights = checkpoint(weighted_templates(counted, templates))
    # Some words of fixed templates, written into the plan.
    some = (F.col("rest") > LIGHT) | (F.col("common") >= threshold**2 - 1e-6)
    heavy = weights.where(some).select("template", "term", "weight", "rest", "common").collect()
    doc = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("id"), "directory", "named", F.xxhash64("text").alias("hash"))
    slim = checkpoint(src.select("doc_id", "directory", doc.alias("doc"), units(F.col("text"), heavy, threshold).alias("units")))
    some = slim.where(F.size("units") > 0).dropDuplicates(["doc"]).select("doc", F.explode("units").alias("u")).select("doc", "u.*")
    found = matches(some, weights, counted, threshold)
    first = F.struct("score", -F.col("kind"), -F.col("no"))
    gives = F.col("doc.named") | (F.col("kind") == 2)
    own = found.groupBy("doc").agg(
        F.max_by("licence", first).alias("own_licence"),
        F.max("score").alias("own_score"),
        F.count_if(F.col("kind") == 0).alias("n_lines"),
        F.count_if(F.col("kind") > 0).alias("n_blocks"),
        F.max_by(F.when(gives, F.col("licence")), F.when(gives, first)).alias("gives"),
    )
    own = checkpoint(own)
    ids = slim.select("doc_id", "doc").distinct().join(own.where("gives IS NOT NULL"), "doc")
    order = F.struct(~F.col("doc.named"), F.col("doc_id").isNull(), "doc_id", "gives")
    files = ids.groupBy("doc.directory").agg(F.min_by("gives", order).alias("file_licence"))
    # Made first, so that its size is known where the ancestors meet it; '' is above every directory.
    given = inherited(slim.select("directory").distinct(), checkpoint(files))
    rows = slim.select("doc_id", "directory", "doc").join(own, "doc", "left").join(given, "directory", "left")
    return rows.select(
        "doc_id",
        "directory",
        "own_licence",
        "own_score",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
        F.coalesce("own_licence", "file_licence").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("from")).alias("inherited_from"),
    )


def inherited(directories: DataFrame, files: DataFrame) -> DataFrame:
    """(directory, file_licence, from): of each directory the nearest one of ``files(directory, file_licence)``, itself or above."""
    parts = F.split("directory", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = directories.select("directory", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), up))).alias("from"))
    met = above.join(files.withColumnRenamed("directory", "from"), "from")
    nearest = F.max_by(F.struct("file_licence", "from"), F.length("from")).alias("n")
    return met.groupBy("directory").agg(nearest).select("directory", "n.*")


def placed() -> Column:
    """The path that the query gives a document: source/<doc_id div 1000>/<doc_id div 50>/, and there LICENSE for the first id of the fifty,
    COPYING.md for the second, and else <doc_id>.txt."""
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).when(F.col("doc_id") % 50 == 1, F.lit("COPYING.md"))
    name = name.otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.expr("doc_id div 1000"), F.expr("doc_id div 50"), F.coalesce(name, F.lit("none.txt")))


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Every document, as the file that ``placed`` makes it."""
    return scan(table(spark, sf_dir, "documents"), path=placed())


_TEXTS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_TERMS = f"regexp_extract_all(lower(text), '{TERM}')"
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
        concat_ws('/', coalesce(source, ''), doc_id // 1000, doc_id // 50) AS directory FROM documents),
t0(template, licence, text) AS (VALUES {_TEXTS}),
t1 AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest({_TERMS}) AS term FROM t0) GROUP BY ALL),
c AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({_TERMS}) AS term FROM d) GROUP BY term),
w AS (SELECT t1.*, ln(((SELECT count(*) FROM d) + 1) / (coalesce(c.n, 0) + 1)) + 1 AS idf FROM t1 LEFT JOIN c USING (term)),
u AS (SELECT *, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM w),
g AS (SELECT *, string_split(text, chr(10)) AS lines, string_split_regex(text, '{GAP}') AS blocks FROM d),
l AS (SELECT doc_id, 0 AS kind, i - 1 AS no, lines[i] AS text FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM g)
      UNION ALL SELECT doc_id, 1, i - 1, blocks[i] FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM g) WHERE contains(blocks[i], chr(10))
      UNION ALL SELECT doc_id, 2, 0, text FROM g WHERE len(blocks) > 1),
p AS (SELECT doc_id, kind, no, term, count(*) AS tf FROM (SELECT doc_id, kind, no, unnest({_TERMS}) AS term FROM l) GROUP BY ALL),
x AS (SELECT p.*, p.tf * (ln(((SELECT count(*) FROM d) + 1) / (c.n + 1)) + 1) AS w FROM p JOIN c USING (term)),
n AS (SELECT doc_id, kind, no, sqrt(sum(w * w)) AS norm FROM x GROUP BY ALL),
s AS (SELECT x.doc_id, x.kind, x.no, u.template, u.licence, round(sum(x.w * u.weight) / any_value(n.norm), 6) AS score
      FROM x JOIN u USING (term) JOIN n ON n.doc_id = x.doc_id AND n.kind = x.kind AND n.no = x.no GROUP BY ALL
      HAVING round(sum(x.w * u.weight) / any_value(n.norm), 6) >= {THRESHOLD}),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, kind, no ORDER BY score DESC, template) = 1),
o AS (SELECT doc_id, arg_max(licence, (score, -kind, -no)) AS own_licence, max(score) AS own_score,
        count(*) FILTER (kind = 0) AS n_lines, count(*) FILTER (kind > 0) AS n_blocks,
        arg_max(licence, (score, -kind, -no)) FILTER (kind = 2 OR doc_id % 50 < 2) AS gives FROM b GROUP BY ALL),
f AS (SELECT directory, arg_min(gives, (doc_id % 50 >= 2, doc_id)) AS file_licence FROM o JOIN d USING (doc_id) WHERE gives IS NOT NULL GROUP BY directory),
i AS (SELECT a.directory, arg_max(f.file_licence, length(f.directory)) AS file_licence, max_by(f.directory, length(f.directory)) AS source_dir
      FROM (SELECT DISTINCT directory FROM d) a JOIN f ON a.directory = f.directory OR starts_with(a.directory, f.directory || '/')
      GROUP BY a.directory)
SELECT d.doc_id, d.directory, own_licence, own_score, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_blocks, 0)::BIGINT AS n_blocks,
  coalesce(own_licence, file_licence) AS licence, CASE WHEN own_licence IS NULL THEN source_dir END AS inherited_from
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN i ON i.directory = d.directory
"""
