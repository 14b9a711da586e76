"""Importance resampling towards a target distribution, by bags of hashed n-grams.

A feature is a run of 1 to ``n`` words, and falls in a bucket by its CRC-32. Counts over all rows and over the target's give each
bucket a gain, the log of how much likelier it is in the target; a row's weight is the sum over its features, and the rows of the
highest weights, each with a Gumbel noise of its own, are drawn without replacement.

Long texts are skewed: one may be as long as thousands of others. They are cut at word boundaries into chunks that are dealt over all
tasks. A chunk carries the n - 1 words after it, and owns the features that start in it, so each feature counts once; counts and weights
of chunks are summed by row. Texts of one chunk never move.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc32_sql, numbered, row_key, shipped, table

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
#: Of the rows of enough words so many in a hundred are drawn.
PERCENT = 10
#: Bytes of a chunk, but for its last word.
CHUNK = 1 << 16
#: Words whose buckets a task remembers.
REMEMBERED = 1 << 17

#: Upper case to lower, and all that is in no word to a space; bytes above 127 are those of other letters.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def chunks_of(text: str | None, n: int = NGRAM, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(words, owned): the lower-cased words of each chunk, parted by spaces, and how many of them start in it.

    At least one chunk, which may be empty. A chunk ends with the word that its last byte is in; the words after the owned ones, n - 1
    at most, are carried from the next.
    """
    plain = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED)
    start = 0
    while True:
        end = plain.find(b" ", start + size)
        end = len(plain) if end < 0 else end
        words = plain[start:end].split()
        owned, at = len(words), end
        for _ in range(n - 1):
            while at < len(plain) and plain[at] == 32:
                at += 1
            if at == len(plain):
                break
            stop = plain.find(b" ", at)
            stop = len(plain) if stop < 0 else stop
            words.append(plain[at:stop])
            at = stop
        yield b" ".join(words), owned
        start = end
        if start >= len(plain):
            return


class Buckets(dict):
    """The bucket of a feature, worked out once for a word that is often met."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = found
        return found


def buckets_of(words: list[bytes], owned: int, n: int, held: Buckets) -> np.ndarray:
    """The buckets of the features that start with one of the first ``owned`` words, repeats included."""
    found = [held[w] for w in words[:owned]]
    for k in range(2, n + 1):
        found += [held[b" ".join(words[i : i + k])] for i in range(min(owned, len(words) - k + 1))]
    return np.array(found, np.int64)


def chunked(docs: DataFrame, carried: list[str], n: int, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Chunks (carried columns, chunk, words, owned) of ``docs(carried..., text)``: those of texts of one chunk, where they lie, and
    those of longer ones, dealt evenly over the tasks."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b, rows):
            at = pa.array([r[0] for r in rows], pa.int32())
            made = (pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int64()), (2, pa.binary()), (3, pa.int64())))
            return pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), *made], names=[*carried, "chunk", "words", "owned"])

        for b in batches:
            rows, held = [], 0
            for i, text in enumerate(b.column(len(carried))):
                for k, (words, owned) in enumerate(chunks_of(text.as_py(), n, size)):
                    rows.append((i, k, words, owned))
                    held += len(words)
                    if held > 64 * size:
                        yield out(b, rows)
                        rows, held = [], 0
            yield out(b, rows)

    length = F.coalesce(F.octet_length("text"), F.lit(0))
    schema = f"{kinds}, chunk long, words binary, owned long"
    short = docs.where(length <= size).mapInArrow(run, schema)
    long = docs.where(length > size).mapInArrow(run, schema)
    return short, long.repartition("chunk", *carried)


def bucket_counts(chunks: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``chunks(words, owned)`` fall in each bucket; as many rows as there are buckets come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(buckets, np.int64), Buckets(buckets)
        for b in batches:
            for words, owned in zip(b.column(0), b.column(1).to_pylist()):
                total += np.bincount(buckets_of(words.as_py().split(), owned, n, held), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["bucket", "n"])

    per_task = chunks.select("words", "owned").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target, smoothed by one, rounded down."""
    n, s, t = len(all_counts), int(all_counts.sum()), int(target_counts.sum())
    return np.array(
        [math.floor(1000 * math.log((float(b + 1) * (s + n)) / (float(a + 1) * (t + n)))) for a, b in zip(all_counts.tolist(), target_counts.tolist())],
        np.int64,
    )


def weighed(chunks: DataFrame, carried: list[str], gain: np.ndarray, n: int = NGRAM) -> DataFrame:
    """(carried columns, chunk, n_words, n_features, weight) of each chunk."""
    spark, kinds = chunks.sparkSession, ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in carried)
    held_gain, width, buckets = shipped(spark, gain), len(carried), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, held = held_gain(), Buckets(buckets)
        for b in batches:
            owned = b.column(width + 2)
            sums = []
            for words, k in zip(b.column(width + 1), owned.to_pylist()):
                found = buckets_of(words.as_py().split(), k, n, held)
                sums.append((len(found), int(gain[found].sum())))
            made = [pa.array([x[j] for x in sums], pa.int64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: width + 1], owned, *made], names=[*carried, "chunk", "n_words", "n_features", "weight"])

    return chunks.mapInArrow(run, f"{kinds}, chunk long, n_words long, n_features long, weight long")


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_features and weight against the texts of ``target``.

    Null and empty texts have no feature and weight 0. Rows alike in id and text get a row each. Other columns are not read. Of no
    rows come no rows; without a target's text all gains are those of an empty one.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.select("doc_id", F.struct(*row_key(src)).alias("key"), "text")
    carried = ["doc_id", "key"]
    short, long = chunked(src, carried, n, chunk)
    long = checkpoint(long)
    wanted, more = chunked(target.select(F.lit(0).alias("key"), F.col(text_col).cast("string").alias("text")), ["key"], n, chunk)
    of_all = bucket_counts(short.select("words", "owned").union(long.select("words", "owned")), n, buckets)
    gain = gains(of_all, bucket_counts(wanted.unionByName(more), n, buckets))
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    # Rows alike have alike chunks: there are as many of them as first chunks, and each gives a row, of at least ``chunk`` bytes.
    whole = weighed(long, carried, gain, n).groupBy(*carried).agg(*sums, F.count_if(F.col("chunk") == 0).alias("rows"))
    each = [F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")]
    whole = whole.select("doc_id", *each, F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")
    return weighed(short, carried, gain, n).select("doc_id", "n_words", "n_features", "weight").unionByName(whole)


def noisy(weight: Column, id_: Column, seed: int = SEED) -> Column:
    """The weight and a Gumbel noise, by a hash of the id, in thousandths, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = NGRAM,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    chunk: int = CHUNK,
) -> DataFrame:
    """``weights`` with score and rank: 1, 2, 3 ... for the rows drawn, null for the rest.

    Of the rows of at least ``least_words`` words ``percent`` in a hundred are drawn, rounded down, by score, ties by the smaller id, and
    a null id, whose noise is that of an empty one, after all others. Rows that are alike in both stand in any order.
    """
    found = weights(docs, target, id_col, text_col, n, buckets, chunk)
    found = checkpoint(found.withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)))
    enough = F.col("n_words") >= least_words
    draws = found.where(enough).count() * percent // 100
    # The cut lies at one score; only rows from there on have a place. An estimate from below is enough to leave the others out.
    low = found.where(enough).agg(F.percentile_approx("score", max(0.0, 1 - 1.1 * percent / 100 - 0.001), 10_000)).first()[0]
    near = enough & (F.col("score") >= F.lit(low)) if low is not None else F.lit(False)
    if low is not None and found.where(near).count() < draws:
        near = enough
    order = [(-F.col("score")).alias("by"), F.col("doc_id").isNull().alias("none")]
    near_rows = found.where(near).select("*", *order, F.lit("").alias("all"))
    placed = numbered(near_rows, "all", ["by", "none", "doc_id"], "at")
    placed = placed.withColumn("rank", F.when(F.col("at") < draws, F.col("at") + 1)).select(*found.columns, "rank")
    return placed.unionByName(found.where(~F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def drawn_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The sample itself: the rows of ``docs`` whose ids are drawn, with all their columns. Rows without an id are left out."""
    drawn = resample(docs, target, id_col, **settings).where("rank IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(drawn, docs[id_col] == drawn["doc_id"], "left_semi")


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, the target being the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT rid, unnest(w) AS w FROM d),
g AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
c AS (SELECT w, ({crc32_sql('w')} % {BUCKETS})::BIGINT AS b FROM (SELECT w FROM f UNION SELECT w FROM g)),
s AS (SELECT b, count(*) AS n FROM f JOIN c USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN c USING (w) GROUP BY b),
v AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + {BUCKETS})
        / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM g) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
k AS (SELECT rid, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN c USING (w) JOIN v USING (b) GROUP BY rid),
h AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN k USING (rid)),
r AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place FROM r)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {LEAST_WORDS} AND place <= (SELECT count(*) FROM o WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN place END AS rank FROM o
"""
