"""Queries over models that are fitted on the tables themselves, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import detect, language, tagger
from . import derived as dv

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنهو"
#: Every document in its language, and one of seven of them once more in Arabic letters.
TEXTS = f"""SELECT doc_id, text, lang FROM {{documents}} UNION ALL
SELECT -1 - doc_id AS doc_id, translate(lower(text), '{_LATIN}', '{_ARABIC}') AS text, 'ar' AS lang FROM {{documents}} WHERE doc_id % 7 = 0"""


def texts(spark, sf_dir) -> DataFrame:
    return dv.frame(spark, sf_dir, TEXTS)


@query
def language_counts(spark, sf_dir):
    return language.counted(texts(spark, sf_dir))


@query
def language_identified(spark, sf_dir):
    rows = texts(spark, sf_dir)
    return language.identified(rows, language.fit(rows), keep=["doc_id"]).select("doc_id", "language", "score", "margin")


@query
def language_held_out(spark, sf_dir):
    return language.held_out(texts(spark, sf_dir))


@query
def language_routes(spark, sf_dir):
    rows = texts(spark, sf_dir)
    said = language.identified(rows, language.fit(rows), keep=["doc_id"]).select("doc_id", "language")
    return detect.routes(said, language.route_language(F.col("language"))).select("doc_id", "language", "detector_ord", "detector")


@query
def tagger_held_out(spark, sf_dir):
    """What a tagger finds of the spans that patterns mark in texts that it was not fitted on."""
    chunks = dv.id_texts(spark, sf_dir).withColumnRenamed("text", "chunk")
    found = detect.recognise_all(chunks).select(*detect.CHUNK_KEY, "text", "label")
    found = found.unionByName(detect.indian_ids(chunks).select(*detect.CHUNK_KEY, "text", "label"))
    return tagger.held_out(tagger.marked(chunks, found))


def _language_sql(rows: str, fitted: str = "true") -> str:
    """CTEs from (rid, text, lang) rows on: c has the counts of the fitted ones, said what the model says of each row."""
    b = language.BUCKETS
    return rf"""
t AS (SELECT *, string_split(trim(regexp_replace(lower(text), '[\x00-\x60\x7B-\x7F]+', ' ', 'g')), '') AS l FROM ({rows})),
g AS (SELECT rid, lang, {fitted} AS fitted, unnest(list_transform(range(1, len(l) + 1), lambda i: ((CASE WHEN i > 1 THEN unicode(l[i - 1]) ELSE 32 END::BIGINT * {language.FACTOR}
      + unicode(l[i])) * {language.FACTOR} + CASE WHEN i < len(l) THEN unicode(l[i + 1]) ELSE 32 END) % {b})) AS bucket FROM t WHERE len(l) > 0 AND l <> ['']),
c AS (SELECT lang, bucket, count(*) AS n FROM g WHERE fitted AND lang IS NOT NULL GROUP BY lang, bucket),
z AS (SELECT lang, sum(n)::BIGINT AS n FROM c GROUP BY lang),
p AS (SELECT z.lang, u.bucket, floor(1000 * ln((coalesce(c.n, 0) + 1)::DOUBLE / (z.n + {b})::DOUBLE))::BIGINT AS w
      FROM z CROSS JOIN (SELECT DISTINCT bucket FROM g) u LEFT JOIN c ON c.lang = z.lang AND c.bucket = u.bucket),
k AS (SELECT g.rid, p.lang AS language, sum(p.w)::BIGINT AS score FROM g JOIN p USING (bucket) GROUP BY g.rid, p.lang),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, language) AS place FROM k),
said AS (SELECT t.rid, t.lang, coalesce(a.language, '{language.DEFAULT}') AS language, coalesce(a.score, 0) AS score, coalesce(a.score - b.score, 0) AS margin
      FROM t LEFT JOIN o a ON a.rid = t.rid AND a.place = 1 LEFT JOIN o b ON b.rid = t.rid AND b.place = 2)"""


_ROWS = f"SELECT row_number() OVER () AS rid, * FROM ({dv.duck(TEXTS)})"
_ALL = f"WITH x AS ({_ROWS}), {_language_sql('SELECT rid, text, lang FROM x')}"
ORACLE_SQL["language_counts"] = f"{_ALL} SELECT lang, bucket::BIGINT AS bucket, n FROM c"
ORACLE_SQL["language_identified"] = f"{_ALL} SELECT x.doc_id, language, score, margin FROM said JOIN x USING (rid)"
_FOLD = "coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5, 0)"
ORACLE_SQL["language_held_out"] = f"""WITH x AS ({_ROWS}), f AS (SELECT *, {_FOLD} AS fold FROM x WHERE lang IS NOT NULL), {_language_sql('SELECT rid, text, lang, fold FROM f', 'fold <> 0')}
SELECT said.lang, language, count(*) AS n FROM said JOIN f USING (rid) WHERE fold = 0 GROUP BY said.lang, language"""
_ROUTES = " UNION ALL ".join(f"SELECT '{k}' AS route, {i}::INT AS detector_ord, '{d}' AS detector" for k, names in vocab.ROUTES.items() for i, d in enumerate(names))
ORACLE_SQL["language_routes"] = f"""{_ALL} SELECT x.doc_id, language, detector_ord, detector FROM said JOIN x USING (rid)
JOIN ({_ROUTES}) ON route = CASE WHEN language = 'ar' THEN 'ar' ELSE 'en' END"""
