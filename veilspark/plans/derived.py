"""Inputs that queries share, made from the test tables by SQL that Spark and DuckDB both run.

``{name}`` stands for a table. Every row of a table is used: the first run holds every document, and remainders of ids only deal
out which detector says what, or which later run has seen a file again. That some files were deleted or never evaluated is what
the operators over runs are for; there the language or the length decides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab


def _padded(expression: str, width: int) -> str:
    return f"lpad(CAST({expression} AS STRING), {width}, '0')"


_K = "c_custkey"
#: Texts with every kind of identifier, one a customer.
ID_TEXTS = f"""SELECT CAST({_K} AS BIGINT) AS doc_id, 1 AS chunk_index,
  'Customer ' || c_name || ', PAN ABCDE' || {_padded(f"{_K} % 10000", 4)} || 'F; aadhaar ' || {_padded(f"{_K} % 10000", 4)} || ' '
  || {_padded(f"({_K} * 7) % 10000", 4)} || '-' || {_padded(f"({_K} * 13) % 10000", 4)} || '. GST 27ABCDE' || {_padded(f"{_K} % 10000", 4)}
  || 'F1Z5, udyam-mh-12-' || {_padded(_K, 7)} || '; born 15-Aug-19' || {_padded(f"{_K} % 100", 2)} || ', seen 2024-0' || CAST({_K} % 9 + 1 AS STRING)
  || '-1' || CAST({_K} % 9 AS STRING) || '. SSN ' || {_padded(f"{_K} % 1000", 3)} || '-' || {_padded(f"{_K} % 100", 2)} || '-' || {_padded(f"{_K} % 10000", 4)}
  || ' mail User' || CAST({_K} AS STRING) || '@example' || CAST({_K} % 5 AS STRING) || '.com, again user' || CAST({_K} AS STRING) || '@EXAMPLE'
  || CAST({_K} % 5 AS STRING) || '.com; host 10.0.' || CAST({_K} % 256 AS STRING) || '.' || CAST({_K} % 300 AS STRING) || ' call +44 20 7946 '
  || {_padded(f"{_K} % 10000", 4)} || ' card 4111 1111 1111 ' || {_padded(f"{_K} % 10000", 4)} || ' see https://example.com/a/' || CAST({_K} AS STRING)
  || ' key ' || md5(c_name) || ' id ' || substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-'
  || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) || ' hash ' || md5(c_name) || md5(c_mktsegment) AS text
FROM {{customer}}"""

_WHO = "CAST(c_custkey AS BIGINT) AS doc_id, 1 AS chunk_index"


def _said(detector: str, ord: int, pos: int, text: str, label: str, score: str, where: str) -> str:
    return f"""SELECT {_WHO}, '{detector}' AS detector, {ord} AS detector_ord, {pos} AS pos, {text} AS text, {label} AS label,
  CAST({score} AS DOUBLE) / 100 AS score FROM {{customer}} WHERE {where}"""


#: What three detectors say about every customer: alike, differently, and alone.
DETECTIONS = " UNION ALL ".join(
    [
        _said("presidio", 0, 0, "c_name", "'person'", f"50 + {_K} % 50", "true"),
        _said("presidio", 0, 1, f"'2024-01-' || {_padded(f'{_K} % 28 + 1', 2)}", "'date'", "85", f"{_K} % 3 = 0"),
        _said("presidio", 0, 2, f"{_padded(f'{_K} % 10000', 4)} || ' 5678 9012'", "'date of birth'", f"40 + {_K} % 7", f"{_K} % 5 = 0"),
        _said("gliner_xlarge", 1, 0, "lower(c_name)", f"CASE WHEN {_K} % 2 = 0 THEN 'name' ELSE 'Person' END", f"40 + {_K} % 60", f"{_K} % 4 < 3"),
        _said("gliner_xlarge", 1, 1, f"'Acme ' || CAST({_K} % 9 AS STRING)", "'organization'", "50", f"{_K} % 2 = 0"),
        _said("gliner_xlarge", 1, 2, f"'Born ' || {_padded(f'{_K} % 10000', 4)}", "'dob'", "60", f"{_K} % 6 = 0"),
        _said("qwen", 2, 0, f"'ACME ' || CAST({_K} % 9 AS STRING)", "'organization name'", "80", f"{_K} % 4 = 0"),
        _said("qwen", 2, 1, f"'born ' || {_padded(f'{_K} % 10000', 4)}", "CASE WHEN c_custkey % 12 = 0 THEN 'date_of_birth' ELSE 'date' END", "70", f"{_K} % 3 = 0"),
        _said("qwen", 2, 2, f"'ABCDE' || {_padded(f'{_K} % 10000', 4)} || 'F'", "'organization'", "30", f"{_K} % 7 = 0"),
        _said("qwen", 2, 3, "'Maharashtra - 400001'", "'organization'", "75", f"{_K} % 11 = 0"),
        _said("qwen", 2, 4, "'Patient Care'", "'organization'", "75", f"{_K} % 13 = 0"),
    ]
)
#: Labelled values of every kind, with the labels that decide their shape.
VALUES = f"""SELECT CAST({_K} AS BIGINT) AS doc_id, p AS kind,
  CASE p WHEN 0 THEN c_name WHEN 1 THEN 'user' || CAST({_K} AS STRING) || '@example.com' WHEN 2 THEN '+4' || CAST({_K} % 10 AS STRING) || ' 70 1234 ' || {_padded(f"{_K} % 10000", 4)}
    WHEN 3 THEN '0' || CAST(700000000 + {_K} AS STRING) WHEN 4 THEN '4111 1111 1111 ' || {_padded(f"{_K} % 10000", 4)}
    WHEN 5 THEN CAST({_K} * 7919 AS STRING) WHEN 6 THEN '1990-08-' || {_padded(f"{_K} % 28 + 1", 2)} WHEN 7 THEN {_padded(f"{_K} % 28 + 1", 2)} || '/08/1990'
    WHEN 8 THEN '08/' || {_padded(f"{_K} % 28 + 1", 2)} || '/90' WHEN 9 THEN 'ABCDE' || {_padded(f"{_K} % 10000", 4)} || 'F'
    WHEN 10 THEN {_padded(f"{_K} % 10000", 4)} || ' 5678 9012' WHEN 11 THEN '10.0.0.' || CAST({_K} % 300 AS STRING) WHEN 12 THEN {_padded(f"{_K} % 1000", 3)} || '-12-' || {_padded(f"{_K} % 10000", 4)}
    WHEN 13 THEN 'Metformin ' || CAST({_K} % 1000 AS STRING) || 'mg' WHEN 14 THEN 'DOB' WHEN 15 THEN 'Coordination' WHEN 16 THEN 'Bid Insurance'
    WHEN 17 THEN substr(md5(c_name), 1, {_K} % 33) WHEN 18 THEN 'UDYAM-MH-12-' || {_padded(_K, 7)} ELSE ' ' END AS value,
  CASE p WHEN 0 THEN 'person' WHEN 1 THEN 'email address' WHEN 2 THEN 'phone number' WHEN 3 THEN 'phone' WHEN 4 THEN 'credit card number' WHEN 5 THEN 'bank account number'
    WHEN 6 THEN 'date' WHEN 7 THEN 'date of birth' WHEN 8 THEN 'date' WHEN 9 THEN 'pan number' WHEN 10 THEN 'aadhaar number' WHEN 11 THEN 'ip' WHEN 12 THEN 'ssn'
    WHEN 13 THEN 'person' WHEN 14 THEN 'date of birth' WHEN 15 THEN 'suspicious_token' WHEN 16 THEN 'Organization' WHEN 17 THEN 'suspicious_token'
    WHEN 18 THEN 'udyam_number' ELSE 'name' END AS label,
  CAST(({_K} * 37 + p * 11) % 101 AS DOUBLE) / 100 AS score
FROM {{customer}} CROSS JOIN (SELECT CAST(r_regionkey * 4 + o AS INT) AS p FROM {{region}} CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS four) AS kinds"""
#: Runs over the documents: one over all of them, then three over parts, with findings counted by length.
SCANS = " UNION ALL ".join(
    f"""SELECT '2026-03-1{r}_10-00-00' AS run_id, '2026-03-1{r}T10:00:00' AS created_at, source || '/' || CAST(doc_id AS STRING) || '.txt' AS file_name,
  CAST((n_chars + {r}) % 17 AS BIGINT) AS our_entities FROM {{documents}} WHERE doc_id % {m} = 0"""
    for r, m in ((4, 1), (5, 2), (6, 3), (7, 5))
)
_FILE = "source || '/' || CAST(doc_id AS STRING) || '.txt' AS file_name"
#: Of all documents but the Spanish ones, which no one has evaluated.
EVALUATIONS = f"""SELECT {_FILE}, CAST(n_chars % 13 AS BIGINT) AS llm_entities, CAST(n_chars % 13 - n_chars % 4 % (n_chars % 13 + 1) AS BIGINT) AS same,
  CAST(n_chars % 4 % (n_chars % 13 + 1) AS BIGINT) AS different_llm, CAST(50 AS DOUBLE) AS recall_pct, CAST(25 AS DOUBLE) AS precision_pct,
  CASE WHEN doc_id % 28 = 0 THEN 'timeout' WHEN doc_id % 21 = 0 THEN '' END AS llm_error FROM {{documents}} WHERE lang != 'es'"""
#: Each file's part in each run, with its source and language, and its evaluation where there is one.
MEASURED = f"""SELECT s.run_id, d.source, d.lang, s.our_entities, coalesce(e.llm_entities, 0) AS llm_entities, coalesce(e.same, 0) AS same
FROM ({SCANS}) AS s JOIN (SELECT {_FILE}, source, lang FROM {{documents}}) AS d ON s.file_name = d.file_name
LEFT JOIN ({EVALUATIONS}) AS e ON s.file_name = e.file_name"""
LEVELS = [["run_id", "source", "lang"], ["run_id", "source"], ["run_id"], ["source"], ["lang"], []]
#: Files of over 9,000 characters were deleted.
DELETED = f"SELECT {_FILE} FROM {{documents}} WHERE n_chars > 9000"
#: Every file, and of each a copy that no run has seen.
WANTED = f"SELECT {_FILE} FROM {{documents}} UNION ALL SELECT source || '/' || CAST(doc_id AS STRING) || '.bak' AS file_name FROM {{documents}}"
#: Entities of two detectors on customers, in order.
_E = "CAST(c_custkey AS BIGINT) AS doc_id"
OURS = " UNION ALL ".join(
    [
        f"SELECT {_E}, 0 AS pos, lower(c_name) AS value, 'person' AS label FROM {{customer}}",
        f"SELECT {_E}, 1 AS pos, 'acme ' || CAST({_K} % 9 AS STRING) AS value, 'organization' AS label FROM {{customer}} WHERE {_K} % 2 = 0",
        f"SELECT {_E}, 2 AS pos, 'city of ' || lower(c_mktsegment) AS value, 'city' AS label FROM {{customer}} WHERE {_K} % 3 = 0",
    ]
)
THEIRS = " UNION ALL ".join(
    [
        f"SELECT {_E}, 0 AS pos, substr(lower(c_name), 1, 8 + {_K} % 12) AS value, 'name' AS label FROM {{customer}} WHERE {_K} % 5 < 4",
        f"SELECT {_E}, 1 AS pos, lower(c_name) AS value, 'person' AS label FROM {{customer}} WHERE {_K} % 5 < 3",
        f"SELECT {_E}, 2 AS pos, lower(c_mktsegment) AS value, 'home address' AS label FROM {{customer}} WHERE {_K} % 2 = 1",
        f"SELECT {_E}, 3 AS pos, 'acme ' || CAST({_K} % 9 AS STRING) AS value, 'company' AS label FROM {{customer}} WHERE {_K} % 4 = 0",
    ]
)


def dealt(words, key: str = "c_custkey", table: str = "customer", value: str = "label") -> str:
    """(ord, label): every row of a table with the one of the words that its key deals it."""
    pairs = " UNION ALL ".join(f"SELECT {i} AS i, '" + w.replace("'", "''") + "' AS w" for i, w in enumerate(words))
    return f"SELECT CAST({key} AS BIGINT) AS ord, w AS {value} FROM {{{table}}} JOIN ({pairs}) AS words ON {key} % {len(words)} = i"


RAW_LABELS = dealt([*vocab.SHARED_LABELS, *(w.upper().replace(" ", "_") for w in vocab.ZERO_SHOT_LABELS), " person ", "NRP", "Some_Thing", ""])
OUR_LABELS = dealt([*vocab.ZERO_SHOT_LABELS, *vocab.SLM_LABELS, " DOB ", "Pan"])
_LABELS = [*dict.fromkeys((*vocab.ZERO_SHOT_LABELS, *vocab.SLM_LABELS, "dob", "location", "organization name"))]
#: Two labels for each order, so that all pairs of them occur.
LABEL_PAIRS = f"""SELECT a.ord, a.label, b.label_2 FROM ({dealt(_LABELS, "o_orderkey", "orders")}) AS a
JOIN ({dealt(_LABELS, "(o_custkey + o_orderkey * 7)", "orders", "label_2").replace("CAST((o_custkey + o_orderkey * 7) AS BIGINT)", "CAST(o_orderkey AS BIGINT)")}) AS b ON a.ord = b.ord"""
#: What a form has beside its fields: phrases as they are, in another case, and with a customer's name behind them.
FORM_TEXTS = f"""SELECT ord, CASE ord % 4 WHEN 0 THEN upper(phrase) WHEN 1 THEN phrase || ' ' || c_name ELSE phrase END AS text
FROM ({dealt([*vocab.FORM_PHRASES, *vocab.COMMON_WORDS, " Pan Number "], value="phrase")}) AS p JOIN {{customer}} ON ord = c_custkey"""
STAGES = ("extract", "chunk", "detect", "agree", "audit", "replace", "report")
#: For each event a stage, and the stage that its user is at.
STAGE_EVENTS = f"""SELECT a.ord, a.label, b.current FROM ({dealt(STAGES, "event_id", "events")}) AS a
JOIN ({dealt(STAGES, "(user_id + event_id * 3)", "events", "current").replace("CAST((user_id + event_id * 3) AS BIGINT)", "CAST(event_id AS BIGINT)")}) AS b ON a.ord = b.ord"""


def names(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


#: Rows of a table of short rows that one task takes, where much is made of each.
TASK_ROWS = 4096


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by their key, a task for every ``TASK_ROWS`` of them.

    A file of short rows is one row group for up to a million of them, and so one task, however much is made of each row.
    """
    n = -(-rows.count() // TASK_ROWS)
    return rows.repartition(n, key) if n > 1 else rows


def frame(spark: SparkSession, sf_dir: str, sql: str, by: dict[str, str] | None = None) -> DataFrame:
    """The input as a DataFrame over the tables of a folder; those of ``by`` are spread by the key that it names."""
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names(sql)}
    return spark.sql(sql, **tables | {n: spread(tables[n], key) for n, key in (by or {}).items()})


def id_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, ID_TEXTS, {"customer": "c_custkey"})


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, VALUES, {"customer": "c_custkey"})


def duck(sql: str) -> str:
    """The input as DuckDB SQL."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
