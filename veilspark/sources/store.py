"""The run store: reports and metadata of runs, evaluations and tombstones, as versioned tables below one folder.

A run's report is a part of its table, of nested rows, one a file. Run ids sort by time. A write that is cut short, wherever, leaves every table
as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ensemble, filters
from ..functions import vocab
from ..functions.labels import plain
from ..functions.text import strip
from .versions import VersionedTable

FINDING = "struct<value:string,pii_type:string,score:double,found_by:array<string>>"
DROPPED = "struct<value:string,pii_type:string,score:double,found_by:array<string>,reason:string>"
LISTED = f"struct<at:int,kind:string,found:array<{FINDING}>>"
REPLACEMENT = "struct<original_value:string,anonymized_value:string,pii_type:string>"
DETECTED = "struct<value:string,pii_type:string,score:double>"
CHUNK = (
    f"struct<chunk_index:int,original:string,anonymized:string,findings:array<{FINDING}>,replacements:array<{REPLACEMENT}>,"
    f"dropped_findings:array<{DROPPED}>,per_detector:map<string,array<{DETECTED}>>>"
)
FILE = (
    f"file_name string, file string, original_text string, anonymized_text string, chunks array<{CHUNK}>, all_findings array<{FINDING}>, "
    f"all_replacements array<{REPLACEMENT}>, all_dropped_findings array<{DROPPED}>, chunks_anonymized int, chunks_not_anonymized int"
)
REPORT = f"run_id string, created_at string, source_files array<string>, total_chunks_anonymized int, total_chunks_not_anonymized int, files array<struct<{FILE.replace(' ', ':').replace(',:', ',')}>>"
EVALUATION = (
    "file_name string, our_entities long, llm_entities long, same long, different_llm long, recall_pct double, "
    "precision_pct double, last_run_id string, llm_error string"
)


#: Of each file of a run: what run metadata has, and the run's totals of the same.
LOG = "struct<chunk_index:int,chunk_size:int,presidio_count:int,gliner_count:int,qwen_count:int,agreed_count:int,replacements_count:int>"
META = f"file_name string, entity_count int, entity_types array<string>, chunks_processed int, chunk_logs array<{LOG}>, created_at string, run_id string"
#: Files of a run, at most, when its rows are written again.
FILES = 8


class RunStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> VersionedTable:
        """One of the tables runs, meta, evaluations and deleted, with all its versions."""
        schema, key = {
            "runs": (f"{FILE}, created_at string, run_id string", None),
            "meta": (META, None),
            "evaluations": (EVALUATION, "file_name"),
            "deleted": ("file_name string", "file_name"),
        }[name]
        self._finish_swap(name)
        return VersionedTable(self.spark, f"{self.folder}/{name}", schema, key)

    def filesystem(self):
        """What makes paths, and the store's Hadoop file system."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make, make(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _finish_swap(self, name: str) -> None:
        """Give a table its name back that an earlier release put aside when it was cut short."""
        make, fs = self.filesystem()
        now, old = make(f"{self.folder}/{name}"), make(f"{self.folder}/.{name}.old")
        if fs.exists(old):
            if fs.exists(now):
                raise OSError(f"{now} and {old} are both there: the one was written while the other was put aside")
            if not fs.rename(old, now):
                raise OSError(f"{old} could not be renamed to {now}")

    # Reports

    def write_run(self, run_id: str, created_at: str, files: DataFrame) -> None:
        """Write a run's file rows; a run written again is replaced as a whole, once its new rows stand."""
        self._write_part("runs", run_id, created_at, files)

    def runs(self) -> DataFrame:
        """All file rows with run_id and created_at; none where nothing was written."""
        return self.table("runs").read()

    def write_meta(self, run_id: str, created_at: str, files: DataFrame) -> None:
        """Write a run's metadata, ``report.run_meta`` rows with the file's name; as a run's file rows."""
        self._write_part("meta", run_id, created_at, files)

    def meta(self) -> DataFrame:
        return self.table("meta").read()

    def _write_part(self, name: str, run_id: str, created_at: str, files: DataFrame) -> None:
        table = self.table(name)
        self._adopt(table)
        rows = files.withColumns({"created_at": F.lit(created_at), "run_id": F.lit(run_id)})
        table.replace_parts(rows, F.lit(run_id), [run_id])

    def _adopt(self, table: VersionedTable) -> None:
        """Make runs of an earlier release the first version."""
        if not table.pointer()["number"] and (old := table._legacy()) is not None:
            table.replace_parts(old, F.col("run_id"), None)

    def import_report(self, path: str) -> DataFrame:
        """File rows of JSON reports: either name of the file counts, and missing scores are 0.8."""
        raw = self.spark.read.schema(REPORT).option("multiLine", True).json(path)
        rows = raw.select("run_id", "created_at", F.explode("files").alias("f")).select("run_id", "created_at", "f.*")
        rows = rows.withColumn("file_name", F.coalesce("file_name", "file"))
        fill = F.transform("all_findings", lambda x: x.withField("score", F.coalesce(x["score"], F.lit(0.8))))
        return rows.withColumn("all_findings", fill)

    def report(self, run_id: str | None = None) -> DataFrame:
        """File rows of a run, by default the latest."""
        rows = self.runs()
        if run_id is None:
            latest = rows.agg(F.max("run_id").alias("run_id"))
            return rows.join(F.broadcast(latest), "run_id")  # one row
        return rows.where(F.col("run_id") == run_id)

    def export_json(self, run_id: str, path: str) -> None:
        """A run's report as one JSON document."""
        rows = self.report(run_id)
        one = F.struct("file_name", *(c for c in rows.columns if c not in ("run_id", "created_at", "file_name", "file")))
        order = lambda a, b: F.when(a["file_name"] < b["file_name"], -1).when(a["file_name"] > b["file_name"], 1).otherwise(0)
        files = F.array_sort(F.collect_list(one), order)
        totals = [F.sum(f"chunks_{k}").alias(f"total_chunks_{k}") for k in ("anonymized", "not_anonymized")]
        # A report is one document by its format; runs are exported one at a time.
        names = F.array_sort(F.collect_set("file_name")).alias("source_files")
        made = rows.groupBy("run_id", "created_at").agg(*totals, names, files.alias("files"))
        made.coalesce(1).write.mode("overwrite").json(path)

    def write_texts(self, files: DataFrame, path: str) -> None:
        """Anonymised texts, a folder for each file."""
        files.select(F.col("anonymized_text").alias("value"), "file_name").write.mode("overwrite").partitionBy("file_name").text(path)

    # Keyed tables

    def evaluations(self) -> DataFrame:
        return self.table("evaluations").read()

    def save_evaluations(self, new: DataFrame) -> None:
        """New rows replace those of the same file; all others stay."""
        self.table("evaluations").upsert(new)

    def deleted(self) -> DataFrame:
        return self.table("deleted").read()

    def delete(self, names: DataFrame) -> None:
        """Tombstones for ``names(file_name)``; their evaluations go."""
        names = names.select("file_name").distinct()
        self.table("deleted").upsert(names)
        self.table("evaluations").remove(names)

    def restore(self) -> None:
        self.table("deleted").clear()

    def migrate(self, least: float = 0.0) -> None:
        """Rewrite all reports by today's rules for findings; reasons of dropped findings stay. Done twice, it does nothing more."""
        table = self.table("runs")
        self._adopt(table)
        rows = rewritten(table.read(), least)
        table.replace_parts(rows.repartition("run_id", F.pmod(F.xxhash64("file_name"), F.lit(FILES))), F.col("run_id"), None)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def relabel_known(findings: Column) -> Column:
    """Findings with suspicious tokens that a detector also named under the id that they look like."""

    def one(f: Column) -> Column:
        suspicious = (plain(F.coalesce(f["pii_type"], F.lit(""))) == "suspicious_token") & F.arrays_overlap(
            F.transform(F.coalesce(f["found_by"], F.array().cast("array<string>")), plain), F.array(*map(F.lit, vocab.NON_AUDIT_SOURCES))
        )
        value = strip(F.coalesce(f["value"], F.lit("")))
        kind = F.when(suspicious & value.rlike(vocab.AADHAAR), F.lit("aadhaar number")).when(suspicious & value.rlike(vocab.PAN), F.lit("pan number"))
        return f.withField("pii_type", F.coalesce(kind, f["pii_type"]))

    return F.transform(findings, one)


def rewritten(files: DataFrame, least: float = 0.0) -> DataFrame:
    """File rows (``FILE``, run_id) whose findings and dropped findings are relabelled, merged and scored at least ``least``.

    First those of each chunk, then, from these, those of the file; where no chunk has any, the file's own are merged. A dropped finding
    keeps the reason of the one that it is spelled like. Lists that were null stay null; no row goes.
    """
    key, kinds = ["run_id", "file_name"], ("findings", "dropped_findings")
    every = {k: f"all_{k}" for k in kinds}

    def merged(rows: DataFrame, at: list[str]) -> DataFrame:
        return filters.min_score(ensemble.dedupe_findings(rows, at), least)

    def listed(found: Column, at: Column, kind: str) -> Column:
        found = F.transform(found, lambda x: F.struct(*(x[f].alias(f) for f in ("value", "pii_type", "score", "found_by"))))
        return F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), relabel_known(found).cast(f"array<{FINDING}>").alias("found"))

    chunks = F.flatten(F.transform("chunks", lambda c: F.array(*(listed(c[k], c["chunk_index"], k) for k in kinds))))
    own = F.array(*(listed(F.col(c), F.lit(-1), k) for k, c in every.items()))
    held = F.filter(chunks, lambda x: F.size(x["found"]) > 0)
    kept = F.filter(own, lambda x: ~F.coalesce(F.exists(held, lambda h: h["kind"] == x["kind"]), F.lit(False)))
    rows = files.select(*key, F.explode(F.concat(F.coalesce(held, F.array().cast("array<" + LISTED + ">")), kept)).alias("l")).select(*key, "l.*")
    rows = rows.select(*key, "at", "kind", F.posexplode("found").alias("ord", "f")).select(*key, "at", "kind", "ord", "f.*")
    parts = merged(rows, [*key, "at", "kind"])
    order = F.row_number().over(Window.partitionBy(*key, "kind").orderBy("at", "ord"))
    whole = merged(parts.withColumn("ord", order), [*key, "kind"]).withColumn("at", F.lit(-1))
    one = F.struct("ord", "value", "pii_type", "score", "found_by")
    lists = parts.where("at >= 0").unionByName(whole).groupBy(*key, "at", "kind").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.dropFields("ord")).alias("found"))
    name = F.concat_ws("/", F.col("at").cast("string"), "kind")
    lists = lists.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(name, "found"))).alias("__lists"))
    lists = lists.select(F.col("run_id").alias("__run"), F.col("file_name").alias("__file"), "__lists")
    new = files.join(lists, F.col("run_id").eqNullSafe(F.col("__run")) & F.col("file_name").eqNullSafe(F.col("__file")), "left")

    def now(at: Column, kind: str, old: Column) -> Column:
        found = F.coalesce(F.try_element_at("__lists", F.concat_ws("/", at.cast("string"), F.lit(kind))), F.array().cast(f"array<{FINDING}>"))
        if kind == "dropped_findings":
            reason = lambda x: F.filter(old, lambda o: strip(o["value"]) == x["value"])
            found = F.transform(found, lambda x: x.withField("reason", F.get(reason(x), F.lit(0))["reason"]))
        return F.when(old.isNotNull(), found)

    def chunk(c: Column) -> Column:
        for k in kinds:
            c = c.withField(k, now(c["chunk_index"], k, c[k]))
        return c.withField("per_detector", filters.min_score_lists(c["per_detector"], least))

    changed = {c: now(F.lit(-1), k, F.col(c)) for k, c in every.items()} | {"chunks": F.transform("chunks", chunk)}
    return new.withColumns(changed).select(*files.columns)


def latest_scans(files: DataFrame) -> DataFrame:
    """(file_name, last_run_id, last_scanned_at): the newest run of every file."""
    newest = F.max_by("created_at", "run_id").alias("last_scanned_at")
    return files.groupBy("file_name").agg(F.max("run_id").alias("last_run_id"), newest).where("file_name IS NOT NULL")


