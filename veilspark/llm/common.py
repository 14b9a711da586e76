"""What the operators of this subpackage share: tables, the shared folder, checkpoints and graph components."""

from __future__ import annotations

import itertools
import os
import pickle
import uuid

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpoint, shared_dir

#: Java spelling of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that parts words.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of one key from which on they are not dealt by it in a join.
HUB = 20_000
#: Edges that a task takes: more tasks for a small graph leave a file each at every step.
EDGES = 50_000
#: Copies of a row that are made at once.
PIECE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a table in the shared folder: Spark knows its size, and broadcasts it in a join only if it is small."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shipped(spark: SparkSession, value):
    """A function that gives ``value`` on the executors, unpacked once a worker; they need not have this package installed."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        if "made" not in held.__dict__:
            held.__dict__["made"] = pickle.loads(held.value)
        return held.__dict__["made"]

    return get


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns, never null, that tell rows apart by id and text."""
    # The mark keeps a null id apart from an empty one.
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return [name.alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash")]


def filesystem(uri: str):
    """The pyarrow file system of a URI or a plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def delete(uri: str) -> None:
    """Delete a folder that nothing reads any more."""
    fs, root = filesystem(uri)
    fs.delete_dir(root)


def attempt_name(root: str, name: str) -> str:
    """The hidden name under which this attempt of a task writes a file."""
    context = TaskContext.get()
    return f"{root}/.{name}.{context.taskAttemptId() if context else 0}"


def settle(fs, part: str, path: str) -> None:
    """Give a whole file its name, which says all that decides its bytes: the attempt, or an input that never changes. If it is there already, a lost
    attempt has written the same, and that one stays."""
    from pyarrow.fs import FileType

    if fs.get_file_info(path).type == FileType.NotFound:
        try:
            fs.move(part, path)
            return
        except OSError:
            if fs.get_file_info(path).type == FileType.NotFound:
                raise
    fs.delete_file(part)


def publish(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder that appears under its name only when it is whole."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    part = attempt_name(root, name)
    with fs.open_output_stream(part) as f:
        f.write(data)
    settle(fs, part, f"{root}/{name}")


def whole_rows(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that none clashes with a name used beside it."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")


def copied(rows: DataFrame, n: Column, name: str, by: list[str]) -> DataFrame:
    """``rows`` once for each number from 0 to n - 1, in ``name``; none where n is 0.

    Copies are dealt in pieces of ``PIECE``, by the columns ``by`` and the piece's number, so neither a row's array nor a task's share grows with how many
    one row has. All rows travel once: they should be slim.
    """
    none = F.array().cast("array<bigint>")
    last = F.least(F.col("__n"), (F.col("__piece") + 1) * PIECE) - 1
    rows = rows.withColumn("__n", n.cast("long"))
    pieces = F.when(F.col("__n") > 0, F.expr(f"sequence(0L, (__n - 1) div {PIECE})")).otherwise(none)
    rows = rows.withColumn("__piece", F.explode(pieces))
    rows = rows.repartition("__piece", *by)
    return rows.withColumn(name, F.explode(F.sequence(F.col("__piece") * PIECE, last))).drop("__n", "__piece")


def numbered(rows: DataFrame, group: str, order: list, name: str = "idx", total: str = "n") -> DataFrame:
    """``rows`` with their place in their group from 0 on, by ``order``, and the group's number of rows; ``group`` is never null.

    Rows are sorted over all tasks, and counted for each group and task; so no task sees a whole group, however large. Of rows that
    the order does not tell apart each has a place of its own.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ordered = checkpoint(ordered.withColumn("__at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__at", 33))  # the upper bits of that id are the task's number
    runs = ordered.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__rows").over(earlier), F.lit(0).cast("long"))
    runs = runs.select(group, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias(total))
    placed = ordered.join(runs, [group, "__part"]).withColumn(name, F.col("__at") + F.col("__shift"))
    return placed.drop("__at", "__part", "__shift")


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes: a byte comes in, then eight bits are shifted out."""
    digit = lambda i: f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), {i}, 1)) - 1)"
    steps = f"flatten(list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: [{digit('i')} * 16 + {digit('i + 1')}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}::BIGINT[]), lambda a, x: {step}), 4294967295)"


def joined_once(rows: DataFrame, once: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``once``, which has each key once and in ``n`` how many of the rows have it; ``once`` is stored by so many ``tasks``.

    Rows of a key that over ``HUB`` of them share are not dealt by it: such keys are few, at most a ``HUB``-th of the rows, and
    a table by themselves, which Spark broadcasts if it is small and else joins by sorting, splitting what is skewed.
    """
    once = checkpoint(once.coalesce(tasks) if tasks else once)
    hubs = once.where(F.col("n") > HUB)
    if hubs.isEmpty():
        return rows.join(once.drop("n"), key)
    hubs = written(hubs.drop("n"), "hubs")
    rest = rows.join(hubs.select(key), key, "left_anti").join(once.where(F.col("n") <= HUB).drop("n"), key)
    return rest.unionByName(rows.join(hubs, key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: (node, root), the root being the component's smallest node.

    Alternates large-star and small-star steps until the edges are stars. A step takes the least neighbour of every node, a
    partial minimum, to all others; the neighbours of a node of very many stay where they are (``joined_once``). Nodes without
    an edge do not appear. A step's tasks, and so its files, are as many as the edges need, whatever the number of shuffle partitions.
    """
    now = checkpoint(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    n = 1 + now.count() // EDGES  # no step has more edges than the one before
    now = now.coalesce(n)
    mark = None
    for _ in itertools.count():
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = joined_once(both, low, "u", n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpoint(large.where("u != v").coalesce(n).distinct().coalesce(n))
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).coalesce(n))
        small = joined_once(large, low, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.union(low.select("u", "m")).where("u != v").coalesce(n).distinct().coalesce(n))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
