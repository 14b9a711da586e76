"""Work is dealt over tasks by rows, not by the files' row groups."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from veilspark.functions import text as tx
from veilspark.operators import ensemble, report
from veilspark.plans import derived as dv
from veilspark.plans import queries
from veilspark.plans.pipeline import TASKS, process


def customers(folder, n):
    names = pa.array([f"Customer#{i:09d}" for i in range(n)], pa.string())
    rows = {"c_custkey": pa.array(range(n), pa.int64()), "c_name": names, "c_nationkey": pa.array([1] * n, pa.int32()), "c_acctbal": pa.array([1.0] * n, pa.float64()), "c_mktsegment": pa.array(["BUILDING"] * n, pa.string())}
    pq.write_table(pa.table(rows), f"{folder}/customer.parquet")
    pq.write_table(pa.table({"r_regionkey": pa.array(range(5), pa.int32())}), f"{folder}/region.parquet")
    return str(folder)


def test_one_row_group_becomes_many_tasks(spark, tmp_path):
    n = 3 * dv.TASK_ROWS + 1
    folder = customers(tmp_path, n)
    for rows, each in ((dv.id_texts(spark, folder), 1), (dv.values(spark, folder), 20)):
        counts = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(counts) == 4 and sum(counts) == n * each and max(counts) < 2 * each * dv.TASK_ROWS
    assert queries.QUERIES["parse_verdicts"](spark, folder).select(F.spark_partition_id()).distinct().count() == 4
    assert dv.id_texts(spark, folder).select(F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first() == (n, 0, n - 1)


def test_small_and_empty_tables_stay_as_they_are(spark, tmp_path):
    for n in (0, 5):
        folder = customers(tmp_path, n)
        assert dv.id_texts(spark, folder).count() == n and dv.values(spark, folder).count() == 20 * n


def test_a_text_is_collapsed_once_however_many_slices_it_has(spark):
    assert repr(tx.chunk_array(F.col("t"))).count("regexp_replace") == 1


def test_chunks_of_one_partition_are_dealt_out(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('mail a', id, '@example.com ', repeat('word ', 700)) AS text").coalesce(1)
    done = process(docs)
    assert done.chunks.rdd.getNumPartitions() >= TASKS * spark.sparkContext.defaultParallelism
    assert sum(n > 0 for n in done.chunks.rdd.glom().map(len).collect()) > 4
    assert done.anonymised.count() == done.chunks.count() == 120


def test_findings_are_made_once_before_they_are_grouped(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(200).selectExpr("id % 20 AS doc_id", "1 AS chunk_index", "concat('v', lpad(id, 3, '0')) AS value", "'person' AS pii_type", "0.5D AS score", "array('x') AS found_by", "id AS ord")
    assert ensemble.dedupe_findings(rows.mapInArrow(counting, rows.schema)).count() == 200
    assert seen.value == 200


def test_reports_take_replacements_that_are_made(spark):
    chunks = spark.createDataFrame([(1, 1, "mail a@example.com"), (2, 1, "none")], "doc_id long, chunk_index int, chunk string")
    done = process(chunks.selectExpr("doc_id", "chunk AS text"))
    told = report.chunk_reports(done.chunks, done.detections, done.findings, None, done.masked)
    listed = report.chunk_reports(done.chunks, done.detections, done.findings, done.replacements, done.anonymised)
    same = {r.doc_id: r.replacements for r in told.collect()}
    assert same == {r.doc_id: r.replacements for r in listed.collect()} and same[1] and same[2] == []
