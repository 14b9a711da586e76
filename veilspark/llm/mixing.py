"""Mixing sources to target weights.

Every row gets a hash-random key. Within each source rows are ordered by the key: they fall into ranges of the key, the
ranges' totals are summed up first, and only then are rows summed up inside their own range. So a prefix sum over a source
of any size needs no task that sees the whole source. A source's budget is cut exactly: whole epochs first, then the rows
in front of the cut, and the row on the cut with the words that are left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE, SPACE, WORD, checkpoint, copied, row_key, table, whole_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Rows of a range of keys, on average over all sources; as many hexadecimal digits of the key name it as that takes.
RANGE_ROWS = 2000
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    spaced = F.translate(text, SPACE[1:], " " * (len(SPACE) - 1))
    return F.coalesce(F.regexp_count(spaced, F.lit("[^ ]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, source_size)``, one row a source.

    The budget, a share of all sizes, is poured by weight; sources that reach ``cap`` times their size stop there, and the
    rest is poured on. Sorted by the level at which they fill up, the first k sources are full for the least k whose level
    does not reach source k + 1. This sees one row for each source, in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("w", w).withColumn("full", F.col("source_size") * F.lit(cap))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("full") / F.col("w"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(share)
    filled, open_w = F.coalesce(F.sum("full").over(before), F.lit(0.0)), F.sum("w").over(every)
    level = (budget - filled) / (open_w - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.when(level < F.col("full") / F.col("w"), level))
    s = s.withColumn("level", F.max("level").over(every))  # from the first such k on, levels fall: the highest is the first
    target = F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("level") * F.col("w")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, and source.

    ``taken`` counts the words that the mix takes, repeats included; over a source they add up to its target, rounded down,
    and no row gives more than ``cap`` times its size, rounded up to whole epochs. A null source is a source of its own and
    comes last; a null or empty text has size 0 and gives nothing; a text of any length has all its words counted. Rows are
    ordered by a hash of their id, then by id and size, so reruns agree. Rows alike in source, id and size, such as repeated
    ones or empty ones without an id, are one row with a count until each gives its own share, in pieces dealt over all tasks; there may be any
    number of them. Sources are weighed in one task: there may be as many as it can sort. Of no rows come no rows. Other columns are
    not read.
    """
    return _cut(_sized(docs, id_col, text_col, source_col, seed), weights, share, cap)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size")
    )
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    return checkpoint(rows.withColumn("key", F.substring(key, 1, 16)))


def _cut(rows: DataFrame, weights: tuple, share: float, cap: float, empty: bool = True) -> DataFrame:
    """What each row gives; without those of no size where ``empty`` is false."""
    digits = max(1, math.ceil(math.log(max(1, rows.count() / RANGE_ROWS), 16)))
    # Rows that nothing tells apart, however many, are one here.
    rows = rows.groupBy("source", "doc_id", "size", "key").agg(F.count("*").alias("n"))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0).cast("long")))
    ranges = ranges.alias("r").join(goal.alias("g"), F.expr("r.source <=> g.source"))
    ranges = ranges.select("r.source", "range", "offset", "source_size", "target")
    all_rows = rows.alias("d").join(ranges.alias("r"), F.expr("d.source <=> r.source and d.range = r.range"))
    own = Window.partitionBy("d.source", "d.range").orderBy("key", "doc_id", "size")
    own = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("size") * F.col("n")
    all_rows = all_rows.withColumn("start", F.col("offset") + F.sum(words).over(own) - words)
    if not empty:
        all_rows = all_rows.where("size > 0")
    all_rows = all_rows.select("doc_id", "size", "source_size", "target", "d.source", "start", "n")
    all_rows = copied(all_rows, F.col("n"), "copy", ["source", "doc_id", "size"])
    goal_words = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = goal_words - epochs * F.col("source_size") - F.col("copy") * F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return all_rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def mixed_rows(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, with all their columns, which may have any name.

    A row on a source's cut gives a last row of the words that are left, joined by spaces; a column n_chars then has the
    length of that. Rows alike in id and text are taken together. Rows without a word, of null or empty text too, are in no
    mix; a null source is one of the sources. Of no rows come no rows.
    """
    key = row_key(docs, id_col, text_col)
    names = ["__id", "__hash"]
    slim = docs.select(F.struct(*key).alias("__key"), F.col(text_col), F.col(source_col))
    taken = _cut(_sized(slim, "__key", text_col, source_col, SEED), weights, share, cap, empty=False).where("taken > 0")
    taken = taken.groupBy("doc_id.__id", "doc_id.__hash").agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size"))
    taken = checkpoint(taken.withColumn("__copies", F.expr("(__taken + __size - 1) div __size")))
    once = docs.select(whole_rows(docs), *key).dropDuplicates(names)
    few, many = F.col("__copies") <= PIECE, taken.where(F.col("__copies") > PIECE)
    rows = once.join(taken.where(few), names).withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    if not many.isEmpty():
        # Texts of which thousands are taken are few: only these travel in pieces.
        rows = rows.unionByName(copied(once.join(many, names), F.col("__copies"), "__copy", names).select(*rows.columns))
    last = F.expr("__taken div __size")
    left = F.expr("__taken % __size").cast("int")
    text = F.col("__row").getField(text_col)
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), 1, left), " ")
    cut = F.col("__copy") >= last
    made = {text_col: F.when(cut, words).otherwise(text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(cut, F.length(words).cast(kind)).otherwise(F.col("__row").getField("n_chars"))
    return rows.select(*(made.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


_WEIGHT = "CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || '{SEED}'), 1, 16) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap, {_WEIGHT} AS w FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
        - coalesce(sum(cap) OVER before, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size,
        least(cap, (SELECT max(level) FROM l WHERE level < cap / w) * w) AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS goal,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size
   + greatest(0, least(size, goal - CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM p
"""
