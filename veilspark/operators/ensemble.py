"""Detections of several detectors made one: merging, agreement, relabelling and finding groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import checkpoint
from ..functions import labels as lb
from ..functions import vocab
from ..functions.text import let, span_context, strip
from ..workers.calls import side_by_side
from . import grouping
from .detect import CHUNK_KEY


def _best(df: DataFrame, key: list[Column], picked: list[Column]) -> DataFrame:
    """Of each key the row of the highest score, of equals that of the earliest detector and place."""
    order = [F.col("score")] + [-F.col(c) for c in ("detector_ord", "pos") if c in df.columns]
    best = F.max_by(F.struct(*picked), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("b")
    return df.groupBy(*key).agg(best)


def dedup_detections(df: DataFrame) -> DataFrame:
    """One detection for each text and label of a chunk and detector, trimmed, labels in lower case; blank ones are gone."""
    group = [c for c in (*CHUNK_KEY, "detector", "detector_ord") if c in df.columns]
    t, x = strip(F.col("text")), lb.plain(F.col("label"))
    rest = ["pos"] if "pos" in df.columns else []
    rows = df.where((t != "") & (x != ""))
    picked = [t.alias("text"), x.alias("label"), F.col("score"), *map(F.col, rest)]
    key = [F.col(c) for c in group] + [F.lower(t).alias("low"), x.alias("key")]
    return _best(rows, key, picked).select(*group, *(f"b.{c}" for c in (*rest, "text", "label", "score")))


def merge(df: DataFrame) -> DataFrame:
    """The union of all detectors: of each text and canonical label the best, under that label."""
    picked = [F.col("text"), lb.canonical(F.col("label")).alias("label"), F.col("score")]
    key = [*map(F.col, CHUNK_KEY), F.lower("text").alias("low"), lb.canonical(F.col("label")).alias("key")]
    return _best(df, key, picked).select(*CHUNK_KEY, "b.text", "b.label", "b.score")


def votes(merged: DataFrame, df: DataFrame) -> DataFrame:
    """``merged`` with found_by, the sorted detectors that have the text under an agreeing label, and n_votes."""
    voters = df.select(*CHUNK_KEY, F.lower("text").alias("low"), F.col("label").alias("said"), "detector").distinct()
    mine = merged.withColumn("low", F.lower("text"))
    met = mine.join(voters, [*CHUNK_KEY, "low"], "left")
    by = F.array_sort(F.collect_set(F.when(lb.agrees(F.col("said"), F.col("label")), F.col("detector"))))
    met = met.groupBy(*CHUNK_KEY, "text", "label", "score").agg(by.alias("found_by"))
    return met.withColumn("n_votes", F.size("found_by").cast("long"))


def required(label: Column, least: int, least_names: int = 1) -> Column:
    return F.when(lb.is_person(label), F.lit(least_names)).otherwise(F.lit(least))


def voted(df: DataFrame, least: int = 1, least_names: int = 1) -> DataFrame:
    """The union of all detectors with found_by, n_votes and reason: null for what enough detectors agree on, persons by a threshold of
    their own, else why it is dropped."""
    found = votes(merge(df), df)
    if least <= 1 and least_names <= 1:
        return found.withColumn("reason", F.lit(None).cast("string"))
    need = required(F.col("label"), least, least_names)
    reason = F.concat(F.lit("agreement < required (kept only when at least "), need.cast("string"), F.lit(" detector(s) agree)"))
    return found.withColumn("reason", F.when(F.col("n_votes") < need, reason))


def agreement(df: DataFrame, least: int = 1, least_names: int = 1) -> DataFrame:
    """What enough detectors agree on; with found_by and n_votes."""
    return voted(df, least, least_names).where("reason IS NULL").drop("reason")


def dropped(df: DataFrame, least: int, least_names: int = 1) -> DataFrame:
    """What too few detectors agree on, with the reason."""
    return voted(df, least, least_names).where("reason IS NOT NULL")


def weighted_agreement(df: DataFrame, weights: DataFrame, least: float = 0.5) -> DataFrame:
    """An extension: what detectors of enough weight agree on. ``weights(detector, weight)``; unknown detectors weigh nothing."""
    voted = votes(merge(df), df).withColumn("detector", F.explode_outer("found_by"))
    voted = voted.join(weights, "detector", "left")
    total = F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight")
    voted = voted.groupBy(*CHUNK_KEY, "text", "label", "score", "found_by").agg(total)
    return voted.where(F.col("weight") >= least)


def relabel_suspicious(df: DataFrame, detections: DataFrame) -> DataFrame:
    """``df`` with suspicious tokens under the label that a detector gave the same text: an id if any, else the first."""
    t, x = strip(F.col("text")), lb.plain(F.col("label"))
    spoken = (
        F.when(t.rlike(vocab.AADHAAR) | x.contains("aadhaar"), F.lit("aadhaar number"))
        .when(t.rlike(vocab.PAN) | x.contains("pan"), F.lit("pan number"))
        .otherwise(x)
    )
    said = detections.where((t != "") & (x != "suspicious_token"))
    said = said.select(*CHUNK_KEY, F.lower(t).alias("low"), spoken.alias("said"), "detector_ord", "pos")
    # Each id overwrites, so the last id said counts; without one the first label does.
    id_said = F.col("said").isin("aadhaar number", "pan number")
    at = F.struct("detector_ord", "pos")
    said = said.groupBy(*CHUNK_KEY, "low").agg(
        F.coalesce(F.max_by(F.when(id_said, F.col("said")), F.when(id_said, at)), F.min_by("said", at)).alias("said")
    )
    met = df.withColumn("low", F.lower(t)).join(said, [*CHUNK_KEY, "low"], "left")
    suspicious = (x == "suspicious_token") & F.col("said").isNotNull()
    return met.select(*(F.when(suspicious, F.col("said")).otherwise(F.col("label")).alias("label") if c == "label" else F.col(c) for c in df.columns))


def findings_by_value(df: DataFrame, key: list[str] = CHUNK_KEY) -> DataFrame:
    """(key, low, value, pii_type, score, found_by, ord): findings merged by value in any case.

    ``df`` has value, pii_type, score, found_by and ord. The type and spelling of the highest score count, of equals those of
    the longer value, then the earlier; ord is the earliest. Blank values are gone, blank types are ``entity``.
    """
    v, t = strip(F.col("value")), strip(F.coalesce("pii_type", F.lit("")))
    kind = lb.canonical(F.when(t == "", F.lit("entity")).otherwise(t))
    rows = df.where(F.coalesce(v, F.lit("")) != "").select(
        *key, F.lower(v).alias("low"), v.alias("value"), kind.alias("pii_type"), F.coalesce("score", F.lit(0.8)).alias("score"), "found_by", "ord"
    )
    names = F.transform(F.flatten(F.collect_list(F.coalesce("found_by", F.array().cast("array<string>")))), lambda x: lb.plain(x))
    best = F.max_by(F.struct("value", "pii_type", "score"), F.struct("score", F.length("value"), -F.col("ord")))
    rows = rows.groupBy(*key, "low").agg(
        best.alias("b"), F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))).alias("found_by"), F.min("ord").alias("ord")
    )
    return rows.select(*key, "low", "b.value", "b.pii_type", "b.score", "found_by", "ord")


def holds_either_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def folded(items: Column, empty: Column, fits, new, joined) -> Column:
    """Groups of an array's items, in order: an item joins the first group that it ``fits``, else begins a ``new`` one."""

    def add(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: fits(g, x)), F.lit(True))
        grown = lambda i: F.transform(acc, lambda g, k: F.when(k + 1 == i, joined(g, x)).otherwise(g))
        return let(at, lambda i: F.when(i == 0, F.concat(acc, F.array(new(x)))).otherwise(grown(i)))

    return F.aggregate(items, empty, add)


def cluster(items: Column) -> Column:
    """Findings (low, value, pii_type, score, found_by, ord, sig) grouped in order, as an array.

    One joins the first group whose first label agrees and one of whose values holds or is held. A group gives its longest
    value, of equals that of the higher score, with that one's type and score, all of found_by, and its first ord.
    """
    top = "struct<n:int,score:double,value:string,pii_type:string>"
    group = f"array<struct<sig:struct<form:string,rules:int>,lows:array<string>,top:{top},found_by:array<string>,ord:int>>"

    def of(x: Column) -> Column:
        return F.struct(F.length(x["value"]).alias("n"), x["score"].alias("score"), x["value"].alias("value"), x["pii_type"].alias("pii_type"))

    def new(x: Column) -> Column:
        return F.struct(x["sig"].alias("sig"), F.array(x["low"]).alias("lows"), of(x).alias("top"), x["found_by"].alias("found_by"), x["ord"].alias("ord"))

    def joined(g: Column, x: Column) -> Column:
        n, t = F.length(x["value"]), g["top"]
        better = (n > t["n"]) | ((n == t["n"]) & (x["score"] > t["score"]))
        return F.struct(
            g["sig"].alias("sig"),
            F.concat(g["lows"], F.array(x["low"])).alias("lows"),
            F.when(better, of(x)).otherwise(t).alias("top"),
            F.concat(g["found_by"], x["found_by"]).alias("found_by"),
            g["ord"].alias("ord"),
        )

    def fits(g: Column, x: Column) -> Column:
        return lb.signatures_agree(g["sig"], x["sig"]) & F.exists(g["lows"], lambda m: holds_either_way(m, x["low"]))

    return folded(items, F.array().cast(group), fits, new, joined)


def dedupe_findings(df: DataFrame, key: list[str] = CHUNK_KEY) -> DataFrame:
    """Findings merged by value, then values that hold each other under agreeing labels, in the order of ord.

    Grouping depends on that order, so the findings of one key, few after the first step, are folded as one array; those of a key with
    over ``grouping.LARGE`` of them meet only what an index says can hold them.
    """
    by_value = findings_by_value(df, key).withColumn("sig", lb.signature(F.col("pii_type")))
    item = F.struct(F.col("ord").cast("int").alias("ord"), "low", "value", "pii_type", "score", "found_by", "sig")
    # Both branches read the groups, which would else be made for each.
    groups = checkpoint(by_value.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("items")))
    few = F.size("items") <= grouping.LARGE
    rows = groups.where(few).select(*key, F.explode(cluster(F.col("items"))).alias("g"))
    rows = rows.select(*key, "g.top.value", "g.top.pii_type", "g.top.score", "g.found_by", "g.ord")
    fields = ("value", "pii_type", "score", "found_by", "ord")
    schema = "value string, pii_type string, score double, found_by array<string>, ord int"
    many = grouping.by_key(groups.where(~few), ["items"], lambda items: [tuple(g[f] for f in fields) for g in grouping.clustered(items)], schema)
    rows = rows.unionByName(many)
    by = F.array_sort(F.array_distinct("found_by"))
    return rows.select(*key, "value", "pii_type", F.bround("score", 4).alias("score"), by.alias("found_by"), "ord")


def judge_batches(df: DataFrame, chunks: DataFrame, size: int = 8, radius: int = 72) -> DataFrame:
    """Disputed findings, each value and type once, with their context, numbered in batches of ``size`` a chunk."""
    v, t = strip(F.col("value")), strip(F.col("pii_type"))
    rows = df.where((v != "") & (t != "")).withColumns({"value": v, "pii_type": t})
    rows = rows.groupBy(*CHUNK_KEY, "value", "pii_type").agg(F.max("score").alias("score"))
    n = F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy(F.length("value").desc(), F.lower("value"), "value", "pii_type")) - 1
    rows = rows.withColumn("n", n).join(chunks.select(*CHUNK_KEY, "chunk"), CHUNK_KEY)
    context = span_context(F.col("chunk"), F.col("value"), radius)
    return rows.select(*CHUNK_KEY, F.floor(F.col("n") / size).cast("int").alias("batch"), (F.col("n") % size).alias("id"), "value", "pii_type", "score", context.alias("context"))


def judge(batches: DataFrame, decide, at_once: int = 8) -> DataFrame:
    """Approved findings of ``judge_batches``, scored between 0.72 and 0.95.

    ``decide`` takes a list of dicts (id, value, pii_type, context) and returns {id: approved}; a batch for which it fails is
    skipped. A task asks about ``at_once`` batches side by side.
    """
    asked = F.sort_array(F.collect_list(F.struct("id", "value", "pii_type", "score", "context"))).alias("asked")
    rows = batches.groupBy(*CHUNK_KEY, "batch").agg(asked).drop("batch")
    schema = T.StructType([*rows.select(*CHUNK_KEY).schema, *T._parse_datatype_string("ids array<int>")])
    schema = T.StructType([*schema, rows.schema["asked"]])

    def approved(items: list[dict]) -> list[int]:
        said = decide([{k: v for k, v in x.items() if k != "score"} for x in items])
        return [x["id"] for x in items if said.get(x["id"])]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            said = side_by_side(b.column(2).to_pylist(), approved, at_once)
            ids = pa.array([x for x, _ in said], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, b.column(2)], names=schema.names)

    found = rows.mapInArrow(run, schema).select(*CHUNK_KEY, "ids", F.explode("asked").alias("a"))
    found = found.where(F.array_contains("ids", F.col("a.id"))).select(*CHUNK_KEY, "a.value", "a.pii_type", "a.score")
    score = F.greatest(F.lit(0.72), F.least(F.coalesce("score", F.lit(0.5)), F.lit(0.95)))
    return found.select(*CHUNK_KEY, F.col("value").alias("text"), F.col("pii_type").alias("label"), score.alias("score"))


def add_judged(df: DataFrame, judged: DataFrame) -> DataFrame:
    """Agreed and approved detections as one."""
    return dedup_detections(df.select(*CHUNK_KEY, "text", "label", "score").unionByName(judged))


def without_detected(hits: DataFrame, detected: DataFrame) -> DataFrame:
    """Audit hits whose exact text no detection has."""
    return hits.join(detected.select(*CHUNK_KEY, "text").distinct(), [*CHUNK_KEY, "text"], "left_anti")


