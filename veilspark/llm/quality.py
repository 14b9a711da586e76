"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule rejects a document whose measure lies above a cutoff. For each stratum and rule the cutoffs of a fixed ladder are
tested from the most lenient on, against labelled good documents: a cutoff is certified if, were its rate of false rejections
above the rule's share of the allowed risk, seeing as few as were seen would be less likely than the level. The probability is
the exact binomial tail. Going down a ladder stops at the first failure, so a ladder needs no correction (fixed-sequence
testing); the level is divided by the number of ladders, strata times rules (Bonferroni), and the risk by the number of rules.
So with probability 1 - delta no stratum loses more than alpha of its good documents. A stratum with too few labels for any
cutoff gets none, and nothing is rejected there by that rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, table

ALPHA, DELTA = 0.02, 0.1
#: Rule: its measure in terms of the counts, and its ladder of cutoffs, the most lenient first.
RULES = {
    "symbols": ("n_symbols / n_words", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    "repeats": ("n_repeat_words / n_words", (0.48, 0.45, 0.4, 0.35, 0.3)),
    "long_words": ("word_chars / n_words", (14.0, 12.0, 11.0, 10.0, 9.0, 8.5)),
    "short_words": ("n_words / word_chars", (0.6, 0.5, 0.45, 0.4)),
}
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with the counts of it: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    df = docs.select(*rest, text.alias("__t"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD))
    df = df.select(
        *rest,
        F.regexp_extract_all("__t", F.lit(f"({WORD})")).alias("__w"),
        (F.length("__t") - F.regexp_count("__t", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    # Each step is a projection of its own that names the last one's arrays more than once, so arrays are made once a row.
    n = F.size("__w")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*(F.get("__w", i + k) for k in range(3))))
    counts = ["word_chars", "n_symbols"]
    df = df.select(
        *rest,
        *counts,
        n.cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.select(*rest, *counts, F.when(repeats, placed).otherwise(F.lit(None)).alias("__p"))

    def twice(p: Column, k: Column) -> Column:
        before = F.get("__p", k - 1).getField("h")
        return F.coalesce(before == p["h"], F.lit(False)) | F.coalesce(F.get("__p", k + 1).getField("h") == p["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("__p", twice), lambda p: p["i"]))
    df = df.select(*rest, *counts, starts.alias("__s"))
    # A window adds three words, or as many as lie before the next one.
    gained = F.transform("__s", lambda s, j: F.least(F.lit(3), F.coalesce(F.get("__s", j + 1), s + 3) - s))
    covered = F.aggregate(gained, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*rest, *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), exactly; 1 where k is above the mean, as no small tail lies there."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, add, lambda a: a["s"]))


def thresholds(good: DataFrame, strata: DataFrame, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cut_<rule> ...): the strictest certified cutoff of each rule, null where none is.

    ``good(stratum, measure_<rule> ...)`` are the labelled good documents, ``strata(stratum)`` all strata there are.
    """
    hits = [
        F.count_if(F.col(f"measure_{r}") > c).alias(f"k_{r}_{i}") for r, (_, ladder) in rules.items() for i, c in enumerate(ladder)
    ]
    seen = good.groupBy("stratum").agg(F.count("*").alias("n"), *hits)
    seen = strata.alias("a").join(seen.alias("b"), F.expr("a.stratum <=> b.stratum"), "left").drop(F.col("b.stratum"))
    seen = seen.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    level = F.lit(delta) / (F.count("*").over(Window.partitionBy()) * len(rules))
    seen = seen.withColumn("level", level)
    for r, (_, ladder) in rules.items():
        ok = F.lit(True)
        cut = F.lit(None).cast("double")
        for i, c in enumerate(ladder):
            ok = ok & F.coalesce(tail(F.col("n"), F.col(f"k_{r}_{i}"), alpha / len(rules)) <= F.col("level"), F.lit(False))
            cut = F.when(ok, F.lit(c)).otherwise(cut)
        seen = seen.withColumn(f"cut_{r}", cut)
    return seen.select("stratum", *(f"cut_{r}" for r in rules))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    rules: dict = RULES,
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, stratum, the counts, base_failed and kept.

    Null texts count as empty. A null stratum is a stratum of its own. Labels without an id or quality are left out; of an id
    labelled more than once the lower quality counts. A measure without a denominator rejects nothing. Repeated rows are
    judged alike. Without labels only the base rule rejects. Of no rows come no rows.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    found = checkpoint(measures(src).withColumn("base_failed", F.expr(BASE)))
    by_rule = [F.expr(f"try_divide({m.replace(' / ', ', ')})").alias(f"measure_{r}") for r, (m, _) in rules.items()]
    found = found.select("*", *by_rule)
    quality = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    quality = quality.groupBy(F.col(id_col).alias("doc_id")).agg(F.min("quality").alias("quality"))
    good = found.where("NOT base_failed").join(quality.where("quality = 1"), "doc_id", "left_semi")
    cuts = thresholds(good, found.select("stratum").distinct(), rules, alpha, delta)
    over = [F.coalesce(F.col(f"measure_{r}") > F.col(f"cut_{r}"), F.lit(False)) for r in rules]
    bad = F.col("base_failed")
    for x in over:
        bad = bad | x
    joined = found.alias("f").join(cuts.alias("c"), F.expr("f.stratum <=> c.stratum"), "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select("doc_id", "f.stratum", *counts, "base_failed", (~bad).alias("kept"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base_failed and kept of every document, strata being languages."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("stratum")


def _sql() -> str:
    hits = [(r, i, m, c) for r, (m, ladder) in RULES.items() for i, c in enumerate(ladder)]
    sql_measure = {r: m.replace("n_words / word_chars", "n_words / nullif(word_chars, 0)") for r, (m, _) in RULES.items()}
    sql_measure = {r: m.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)") for r, m in sql_measure.items()}
    p = ALPHA / len(RULES)
    tail_of = (
        f"CASE WHEN k > n * {p}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1)"
        f" - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1) END"
        f" + j * ln({p}::DOUBLE) + (n - j) * ln(1 - {p}::DOUBLE)))) END"
    )
    ladder_rows = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, i, _, c in hits)
    tested = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {m} AS x FROM good" for r, m in sql_measure.items())
    verdict = " OR ".join(
        f"coalesce({m} > (SELECT c.cut FROM cuts c WHERE c.rule = '{r}' AND c.lang IS NOT DISTINCT FROM f.lang), false)"
        for r, m in sql_measure.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, lang, t, regexp_extract_all(t, '{WORD}') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
s AS (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS x FROM r WHERE n > 1),
rep AS (SELECT rid, sum(x)::BIGINT AS n_repeat_words FROM s GROUP BY rid),
f0 AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE_CLASS}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, ({BASE}) AS base_failed FROM f0),
q AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
good AS (SELECT f.* FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM q)),
tested AS ({tested}),
ladder(rule, i, c) AS (VALUES {ladder_rows}),
strata AS (SELECT DISTINCT lang FROM f),
k AS (SELECT s.lang, l.rule, l.i, l.c, count(t.rule) AS n, count(*) FILTER (t.x > l.c) AS k
      FROM strata s CROSS JOIN ladder l LEFT JOIN tested t ON t.rule = l.rule AND t.lang IS NOT DISTINCT FROM s.lang GROUP BY ALL),
p AS (SELECT *, {tail_of} <= {DELTA}::DOUBLE / ((SELECT count(*) FROM strata) * {len(RULES)}) AS ok FROM k),
run AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY i) AS certified FROM p),
cuts AS (SELECT lang, rule, arg_max(c, i) AS cut FROM run WHERE certified GROUP BY lang, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {verdict}) AS kept FROM f
"""


OP6_SQL = _sql()
