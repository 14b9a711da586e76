"""Tables as immutable versions: data is written beside what there is, and counts once a small pointer file names it.

A table is a folder with ``data/<id>/__part=<name>/``, written once and never changed, and ``versions/<number>.json``, which lists the
folders of each part. The version of the highest number counts. A write makes new folders for the parts that it changes, and then, as its last
step, the next pointer; a job that ends before that leaves the table as it was. So rows may be read from a table and written back to it.
Parts are either named by a column, such as a run, or buckets of a key's hash, of which an upsert rewrites only those that it meets. One
job at a time writes a table: a second one that commits the same number fails.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Versions that stay readable.
KEPT = 3
PART = "__part"


class VersionedTable:
    """``key`` names the column by whose hash rows are put into ``buckets`` parts; without it the parts are named by the writer."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    # Files

    def _fs(self):
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make, make(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        make, fs = self._fs()
        return sorted(f.getPath().getName() for f in fs.listStatus(make(folder))) if fs.exists(make(folder)) else []

    def _step(self, what: str) -> None:
        """Called after each step of a write; tests end the job here."""

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read."""
        return [int(n[:-5]) for n in self._names(f"{self.folder}/versions") if n.endswith(".json") and n[:-5].isdigit()]

    def _pointer(self, number: int) -> str:
        return f"{self.folder}/versions/{number:020d}.json"

    def pointer(self, number: int | None = None) -> dict:
        """What a version consists of, by default the last: number, buckets, and parts, a list of folders each."""
        number = max(self.versions(), default=0) if number is None else number
        if not number:
            return {"number": 0, "buckets": self.buckets, "parts": {}}
        make, fs = self._fs()
        stream = fs.open(make(self._pointer(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # Reading

    def _legacy(self) -> DataFrame | None:
        """Rows that an earlier release left as plain Parquet below the folder."""
        plain = [n for n in self._names(self.folder) if n not in ("versions", "data") and n[0] not in "._"]
        if not plain:
            return None
        # With ``basePath`` the names of folders below it, such as a run's, are a column.
        return self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(*(f"{self.folder}/{n}" for n in plain))

    def _read(self, parts: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.folder}/{p}" for part in sorted(parts) for p in parts[part]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the last; none where nothing was written."""
        found = self.pointer(number)
        if not found["number"] and (old := self._legacy()) is not None:
            return old
        return self._read(found["parts"])

    # Writing

    def _commit(self, found: dict, gone: set[str], new: dict[str, list[str]]) -> None:
        parts = {k: v for k, v in found["parts"].items() if k not in gone} | new
        made = {"number": found["number"] + 1, "buckets": found["buckets"], "parts": parts}
        make, fs = self._fs()
        path, hidden = self._pointer(made["number"]), f"{self.folder}/versions/.{uuid.uuid4().hex}"
        fs.mkdirs(make(f"{self.folder}/versions"))
        out = fs.create(make(hidden), False)
        try:
            out.write(bytearray(json.dumps(made, sort_keys=True).encode()))
        finally:
            out.close()
        self._step("pointer written")
        if fs.exists(make(path)) or not fs.rename(make(hidden), make(path)):
            fs.delete(make(hidden), False)
            raise OSError(f"{path} was written by another job")
        self._step("pointer named")
        self._expire()

    def _expire(self) -> None:
        """Drop pointers beyond the last ``KEPT``, and the data that only they name."""
        make, fs = self._fs()
        numbers = self.versions()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        if not old:
            return
        held = {p for n in kept for ps in self.pointer(n)["parts"].values() for p in ps}
        dropped = {p for n in old for ps in self.pointer(n)["parts"].values() for p in ps} - held
        for n in old:
            fs.delete(make(self._pointer(n)), False)
        self._step("old pointers gone")
        used = {p.split("/")[1] for p in held}
        for p in {p if (write := p.split("/")[1]) in used else f"data/{write}" for p in dropped}:
            fs.delete(make(f"{self.folder}/{p}"), True)

    def replace_parts(self, rows: DataFrame, part: Column, gone: list[str] | None) -> None:
        """A version in which the parts ``gone``, or all where None, are no more, and ``rows`` stand under ``part``, a string."""
        found = self.pointer()
        data = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PART, part).write.partitionBy(PART).parquet(f"{self.folder}/{data}")
        self._step("data written")
        prefix = PART + "="
        new = {urllib.parse.unquote(n[len(prefix) :]): [f"{data}/{n}"] for n in self._names(f"{self.folder}/{data}") if n.startswith(prefix)}
        gone = set(found["parts"]) if gone is None else set(gone)
        if not found["number"] and self._legacy() is not None and gone != set(found["parts"]):
            raise ValueError("a table of an earlier release is rewritten as a whole first")
        self._commit(found, gone | set(new), new)

    def _bucket(self, found: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(found["buckets"])).cast("string")

    def _change(self, keys: DataFrame, more: DataFrame | None) -> None:
        found = self.pointer()
        bucket = self._bucket(found)
        if not found["number"] and (old := self._legacy()) is not None:
            met, rows = None, old
        else:
            met = [r[0] for r in keys.select(bucket.alias("b")).distinct().collect()]  # at most as many as there are buckets
            if not met:
                return
            rows = self._read({b: found["parts"][b] for b in met if b in found["parts"]})
        rows = rows.join(keys.select(self.key).distinct(), self.key, "left_anti")
        if more is not None:
            rows = rows.unionByName(more, allowMissingColumns=True)
        self.replace_parts(rows.withColumn(PART, bucket).repartition(PART).drop(PART), bucket, met)

    def upsert(self, new: DataFrame) -> None:
        """``new`` rows take the place of those of the same key; all others stay. Rows of a null key are added."""
        self._change(new.select(self.key), new)

    def remove(self, keys: DataFrame) -> None:
        """Rows whose key is in ``keys`` go."""
        self._change(keys, None)

    def clear(self) -> None:
        """A version without rows; the ones before can still be read."""
        if self.pointer()["number"] or self._legacy() is not None:
            self.replace_parts(self.spark.createDataFrame([], self.schema), F.lit("0"), None)

    def orphans(self) -> list[str]:
        """Data folders that no version names: of jobs that ended before their commit, or that are still at work."""
        held = {p.split("/")[1] for n in self.versions() for ps in self.pointer(n)["parts"].values() for p in ps}
        return [f"data/{n}" for n in self._names(f"{self.folder}/data") if n not in held]

    def remove_orphans(self) -> None:
        """Delete them; only while no job writes the table."""
        make, fs = self._fs()
        for p in self.orphans():
            fs.delete(make(f"{self.folder}/{p}"), True)
