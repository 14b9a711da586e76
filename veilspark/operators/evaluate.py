"""Evaluation against a second detector, and the views over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import agrees, signature, signatures_agree
from ..functions.text import let
from . import grouping
from .ensemble import folded, holds_either_way


def distinct_entities(items: Column) -> Column:
    """Entities (pos, value, label) in order, grouped where labels are equal and one value holds the other.

    Of each group the longest value, the first of equals, with its label made ready for comparison.
    """
    kind = "array<struct<label:string,values:array<string>,top:string>>"

    def fits(g: Column, x: Column) -> Column:
        return g["label"].eqNullSafe(x["label"]) & F.exists(g["values"], lambda v: holds_either_way(v, x["value"]))

    def new(x: Column) -> Column:
        return F.struct(x["label"].alias("label"), F.array(x["value"]).alias("values"), x["value"].alias("top"))

    def joined(g: Column, x: Column) -> Column:
        top = F.when(F.length(x["value"]) > F.length(g["top"]), x["value"]).otherwise(g["top"])
        return F.struct(g["label"].alias("label"), F.concat(g["values"], F.array(x["value"])).alias("values"), top.alias("top"))

    groups = folded(items, F.array().cast(kind), fits, new, joined)
    return F.transform(groups, lambda g: F.struct(g["top"].alias("value"), signature(g["label"], True).alias("sig")))


def greedy_matches(ours: Column, theirs: Column) -> Column:
    """How many of ``theirs`` find, in order, an unused one of ``ours`` whose label agrees and that holds or is held."""

    def take(acc: Column, x: Column) -> Column:
        fit = F.transform(acc["free"], lambda o: signatures_agree(o["sig"], x["sig"]) & holds_either_way(o["value"], x["value"]))
        rest = lambda i: F.filter(acc["free"], lambda _, k: k + 1 != i)
        used = lambda i: F.struct(rest(i).alias("free"), (acc["same"] + 1).alias("same"))
        return let(F.array_position(fit, F.lit(True)), lambda i: F.when(i == 0, acc).otherwise(used(i)))

    start = F.struct(ours.alias("free"), F.lit(0).cast("long").alias("same"))
    return F.aggregate(theirs, start, take, lambda acc: acc["same"])


def candidates(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, our_pos, their_pos): pairs of ``(key, pos, value, label)`` that may be the same entity.

    Values of one key meet only where one has a run of characters, picked by its hash, of the other; those of less than a run's length meet
    under the shorter one's whole value. So a key of many values does not pair them all.
    """
    a, b = (df.select(key, *(F.col(c).alias(f"{w}_{c}") for c in ("pos", "value", "label"))) for w, df in (("our", ours), ("their", theirs)))
    pair = [key, "our_pos", "our_value", "our_label", "their_pos", "their_value", "their_label"]

    def every(v: Column) -> Column:
        n = F.length(v)
        cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(v, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.array(F.lit("")), *(cut(k) for k in range(1, grouping.RUN + 1))))

    def one(v: Column) -> Column:
        # The run of the least hash among those of full length; a shorter value is its own.
        n = F.length(v)
        of = F.transform(F.sequence(F.lit(1), n - grouping.RUN + 1), lambda i: F.substr(v, i, F.lit(grouping.RUN)))
        least = F.array_min(F.transform(of, lambda r: F.struct(F.xxhash64(r).alias("h"), r.alias("r"))))["r"]
        return F.when(n > grouping.RUN, least).otherwise(v)

    def met(longer: DataFrame, held: DataFrame, v: str, w: str) -> DataFrame:
        long, short = longer.withColumn("__run", F.explode(every(F.col(v)))), held.withColumn("__run", one(F.col(w)))
        return long.join(short, [key, "__run"]).where(F.contains(v, w)).select(*pair)

    found = met(a, b, "our_value", "their_value").union(met(b, a, "their_value", "our_value").where("our_value != their_value"))
    return found.where(agrees(F.col("our_label"), F.col("their_label"), evaluator=True)).select(key, "our_pos", "their_pos")


def evaluate(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, our_entities, llm_entities, same, different_llm, recall_pct, precision_pct) of entities ``(key, pos, value, label)``.

    Matching depends on the order, so the entities of one key are folded as arrays, and those of a key with over ``grouping.LARGE`` of them
    meet only what an index says can hold them. Rows without a value or place are left out.
    """
    sides = [df.where("value IS NOT NULL AND pos IS NOT NULL").select(key, F.lit(i).alias("side"), "pos", "value", "label") for i, df in enumerate((ours, theirs))]
    item = F.struct("pos", "value", "label")
    lists = [F.sort_array(F.collect_list(F.when(F.col("side") == i, item))).alias(name) for i, name in enumerate(("ours", "theirs"))]
    rows = sides[0].unionByName(sides[1]).groupBy(key).agg(*lists)
    many = F.size("ours") + F.size("theirs") > grouping.LARGE
    signed = [F.transform(c, lambda x: F.struct(x["value"].alias("value"), x["label"].alias("label"), signature(x["label"], True).alias("sig"))).alias(c) for c in ("ours", "theirs")]
    large = rows.where(many).select(key, *signed)
    large = grouping.by_key(large, ["ours", "theirs"], lambda a, b: [grouping.matched(a, b)], "our_entities long, llm_entities long, same long")
    rows = rows.where(~many).select(key, distinct_entities(F.col("ours")).alias("ours"), distinct_entities(F.col("theirs")).alias("theirs"))
    n = [F.size(c).cast("long").alias(f"{name}_entities") for c, name in (("ours", "our"), ("theirs", "llm"))]
    return with_rates(rows.select(key, *n, greedy_matches(F.col("ours"), F.col("theirs")).alias("same")).unionByName(large))


def rate(part: Column, whole: Column) -> Column:
    """Per cent with one decimal, half to even; 0 of nothing."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    same, theirs, ours = F.col("same"), F.col("llm_entities"), F.col("our_entities")
    return df.withColumns({"different_llm": theirs - same, "recall_pct": rate(same, theirs), "precision_pct": rate(same, ours)})


def dashboard(scans: DataFrame, counts: DataFrame, evaluations: DataFrame, deleted: DataFrame) -> DataFrame:
    """Every scanned file that is not deleted, with its counts in its own last run and its evaluation, newest first.

    ``scans(file_name, last_run_id, last_scanned_at)``, ``counts(run_id, file_name, our_entities)``.
    """
    rows = scans.join(deleted, "file_name", "left_anti")
    rows = rows.join(counts.withColumnRenamed("run_id", "last_run_id"), ["last_run_id", "file_name"], "left")
    said = evaluations.select("file_name", "llm_entities", "same", "different_llm", "recall_pct", "precision_pct", "llm_error")
    rows = rows.join(said.withColumn("evaluated", F.lit(True)), "file_name", "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))
    return rows.orderBy(F.coalesce("last_scanned_at", F.lit("")).desc(), "file_name")


def combined(rows: DataFrame) -> DataFrame:
    """Totals of a dashboard: our entities of all files, the others of the evaluated ones, and rates of the sums."""
    total = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("our_entities", "llm_entities", "same", "different_llm")}
    totals = rows.agg(*total.values())
    return totals.select("*", rate(F.col("same"), F.col("llm_entities")).alias("recall_pct"), rate(F.col("same"), F.col("our_entities")).alias("precision_pct"))


def by_level(rows: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Totals of ``rows(..., our_entities, llm_entities, same)`` at every level, a list of columns, in one aggregation; [] is all rows.

    (level, the columns, n_files, our_entities, llm_entities, same, different_llm, recall_pct, precision_pct): columns that are not of the level are null,
    and rates are those of the sums. A null among a level's values is a value.
    """
    dims = list(dict.fromkeys(c for level in levels for c in level))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("our_entities", "llm_entities", "same")]
    name = F.concat_ws("+", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in dims))
    found = rows.groupingSets([[F.col(c) for c in level] for level in levels], *dims).agg(name.alias("level"), F.count(F.lit(1)).alias("n_files"), *sums)
    return with_rates(found).select(F.when(F.col("level") == "", F.lit("total")).otherwise(F.col("level")).alias("level"), *dims, "n_files", "our_entities", "llm_entities", "same", "different_llm", "recall_pct", "precision_pct")


def pending(names: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Files never evaluated, or whose evaluation failed."""
    met = names.join(evaluations.select("file_name", F.lit(True).alias("seen"), "llm_error"), "file_name", "left")
    return met.where("seen IS NULL OR coalesce(llm_error, '') != ''").select("file_name")
