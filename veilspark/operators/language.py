"""Languages of texts, by character n-grams.

A model holds, for each language, how often each bucket of three neighbouring characters occurs in labelled texts. A text is of the
language that makes its own triples likeliest: the sum of their logs, in thousandths and whole numbers, so that every engine comes to the same. Counts
are made in the tasks, a table of ``BUCKETS`` numbers a language, and only their sums come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab

#: Buckets of triples, and the factor by which a character counts less than the one before it.
BUCKETS, FACTOR = 1 << 15, 1_000_003
#: Languages that a model may have: what comes to the driver is at most so many tables.
MOST_LANGUAGES = 200
#: Characters whose triples are counted at once.
BLOCK = 1 << 16
#: What a text without a letter counts as.
DEFAULT = "en"


def triples(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the triples of a lower-cased text, in blocks: a-z and all beyond ASCII count, runs of others are one space, and a
    space stands at both ends. Nothing where there is no letter."""
    held = np.full(1, 32, np.int64)
    for a in range(0, len(text or ""), BLOCK):
        x = np.frombuffer(text[a : a + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        x = np.concatenate([held, np.where(((x >= 97) & (x <= 122)) | (x > 127), x, 32)])
        x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
        if len(x) > 2:
            yield _buckets(x)
        held = x[-2:]
    if len(held) > 1:
        end = held if held[-1] == 32 else np.r_[held, 32]
        if len(end) > 2:
            yield _buckets(end)


def _buckets(x: np.ndarray) -> np.ndarray:
    return ((x[:-2] * FACTOR + x[1:-1]) * FACTOR + x[2:]) % BUCKETS


@dataclass(frozen=True)
class LanguageModel:
    """``logs[i, b]``: a thousand times the log of how likely bucket b is in the i-th language, rounded down."""

    names: tuple[str, ...]
    counts: np.ndarray

    @property
    def logs(self) -> np.ndarray:
        total = self.counts.sum(axis=1)
        rows = [[math.floor(1000 * math.log((n + 1) / (int(t) + BUCKETS))) for n in row] for row, t in zip(self.counts.tolist(), total)]
        return np.array(rows, np.int64).reshape(len(self.names), BUCKETS)

    def rows(self, spark) -> DataFrame:
        """(lang, bucket, n), to be stored; ``model_of`` makes it a model again."""
        at = np.argwhere(self.counts > 0)
        return spark.createDataFrame(
            pa.table({"lang": [self.names[i] for i in at[:, 0]], "bucket": at[:, 1], "n": self.counts[at[:, 0], at[:, 1]]}).to_pandas(),
            "lang string, bucket long, n long",
        )


def counted(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): triples of all labelled texts; rows without a text or a language count for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                for found in triples(text.as_py()):
                    totals[lang] += np.bincount(found, minlength=BUCKETS)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "bucket", "n"])

    rows = labelled.select(F.lower(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(run, "lang string, bucket long, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model_of(counts: DataFrame) -> LanguageModel:
    """The model of ``counts(lang, bucket, n)``, at most ``BUCKETS`` rows a language; more than ``MOST_LANGUAGES`` are an error."""
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    got = counts.select("lang", "bucket", "n").toArrow()
    made = np.zeros((len(names), BUCKETS), np.int64)
    at = {n: i for i, n in enumerate(names)}
    np.add.at(made, ([at[x] for x in got.column(0).to_pylist()], got.column(1).to_numpy()), got.column(2).to_numpy())
    return LanguageModel(tuple(names), made)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model of all of ``labelled``."""
    return model_of(counted(labelled, text_col, lang_col))


def identified(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with language, score and margin: the likeliest language, the sum of its logs, and how far ahead of the next it is.

    All columns go through Python, or those to ``keep``: without the text, which goes there lower-cased anyway, a worker holds less.

    Of languages that are as likely the first by name counts. A text without a letter, a null one too, is ``DEFAULT``, with score and
    margin 0; so is every text where the model has no language. With one language the margin is 0.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((model.names, model.logs))  # at most ``MOST_LANGUAGES`` tables
    kept = df.columns if keep is None else keep
    schema = T.StructType([T.StructField("__row", df.select(*(F.col(f"`{c}`") for c in kept)).schema), *T._parse_datatype_string("language string, score long, margin long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = held.value
        for b in batches:
            out = []
            for text in b.column(b.num_columns - 1):
                total, seen = np.zeros(len(names), np.int64), False
                for found in triples(text.as_py()):
                    total, seen = total + logs[:, found].sum(axis=1), True
                if not seen or not names:
                    out.append((DEFAULT, 0, 0))
                    continue
                best = int(total.argmax())
                rest = np.delete(total, best)
                out.append((names[best], int(total[best]), int(total[best] - rest.max()) if len(rest) else 0))
            made = [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "language", "score", "margin"])

    low = F.lower(F.col(text_col).cast("string")).alias("__low")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), low)
    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col("__row").getField(c).alias(c) for c in kept), "language", "score", "margin")


def route_language(language: Column) -> Column:
    """The route of a language: that of its own where there is one, else that of ``DEFAULT``."""
    return F.when(language.isin(*vocab.ROUTES), language).otherwise(F.lit(DEFAULT))


def held_out(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """(lang, language, n): texts of one fold of ``folds``, by a hash of their id, by what a model of the others says of them.

    Rows without a language are left out; null ids are in the first fold.
    """
    known = labelled.where(F.col(lang_col).isNotNull())
    hashed = F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    fold = F.coalesce(hashed % folds, F.lit(0))
    rows = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold.alias("fold"))
    model = fit(rows.where("fold != 0"))
    said = identified(rows.where("fold = 0").select("lang", "text"), model, keep=["lang"])
    return said.groupBy("lang", "language").agg(F.count("*").alias("n"))
