"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other. The model of a category sees a text's hashed features and the log-odds that the
chain gave the categories before. While training these come from out-of-fold predictions, so a later model learns from such
odds as it will meet. The models are L1 logistic regressions, fitted on a bounded sample of labelled rows; the cut from which
on a document is rejected comes from the out-of-fold odds too. Every document is then scored where it lies, by looking up the
few words that carry weight.

Features of a text: each distinct word and its beginnings of four to seven bytes (inflected and compounded forms share
them), and how much of it is symbols and repeated words.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shipped, table
from .decontam import words_of

#: The labelled categories in the order of the chain: name and condition on the labels. The one named ``DECIDES`` rejects. The
#: labels have two columns, so the third category is where both are set: a further link of the chain, not a further label.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 AND quality = 0"))
DECIDES = "toxic"
#: Labelled rows to fit on: so many that are toxic and so many that are not, at most, chosen by a hash of their id, and of each
#: kind texts of so many bytes together, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32 << 20
#: Features, and rows, that the fit counts at once.
BLOCK, ROWS = 1 << 18, 512
#: How many missed rows of the deciding category weigh as much as one rejected wrongly.
WRONG_COST = 2.0
FOLDS = 3
HASH_BITS = 22
#: Rows that a feature must be in, and features that a model may have at most.
LEAST_ROWS, SELECTED = 3, 3000
L1 = 1.5e-4
STEPS = 120
CACHE = 300_000
SYMBOLS = b"#*$%&|<>"
#: Log-odds that are passed on are held within this.
MOST_ODDS = 9.0


MASK = (1 << HASH_BITS) - 1
crc32 = zlib.crc32


def word_features(word: bytes) -> set[int]:
    found = {crc32(word, 1) & MASK}
    for k in range(4, min(len(word), 7) + 1):
        found.add(crc32(word[:k], 2) & MASK)
    return found


def text_features(text: str | None, n_words: int, n_distinct: int) -> list[int]:
    raw = (text or "").encode("utf-8", "replace")
    symbols = (len(raw) - len(raw.translate(None, SYMBOLS))) / max(1, n_words)
    repeats = 1 - n_distinct / max(1, n_words)
    return [crc32(b"%d" % min(9, int(symbols * 20)), 3) & MASK, crc32(b"%d" % int(repeats * 10), 4) & MASK]


def features(text: str | None) -> list[int]:
    """Sorted feature ids of a text."""
    words = words_of(text)
    distinct = set(words)
    return sorted({f for w in distinct for f in word_features(w)} | set(text_features(text, len(words), len(distinct))))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(p):
    return np.clip(np.log(np.maximum(p, 1e-12) / np.maximum(1 - p, 1e-12)), -MOST_ODDS, MOST_ODDS)


def counted(numbers: np.ndarray, least: int) -> np.ndarray:
    """``np.bincount`` of small numbers, in blocks: it widens what it is given."""
    out = np.zeros(least, np.int64)
    for a in range(0, len(numbers), BLOCK):
        out += np.bincount(numbers[a : a + BLOCK], minlength=least)
    return out


class Rows:
    """Numbers of features of rows, side by side, and whose they are, four bytes each; ``ids`` are the numbered features."""

    def __init__(self, flat: np.ndarray, owner: np.ndarray, n: int, ids: np.ndarray):
        self.flat, self.owner, self.n, self.ids = flat.astype(np.int32, copy=False), owner.astype(np.int32, copy=False), n, ids

    @classmethod
    def of(cls, flat: np.ndarray, owner: np.ndarray, n: int) -> Rows:
        """Of feature ids; those that no model takes up, as too few rows have them, are left out."""
        ids = np.flatnonzero(counted(flat, MASK + 1) >= LEAST_ROWS)
        place = np.full(MASK + 1, -1, np.int32)
        place[ids] = np.arange(len(ids))
        number = place[flat]
        return cls(number[number >= 0], owner[number >= 0], n, ids)

    def where(self, mask: np.ndarray) -> Rows:
        keep, number = mask[self.owner], np.cumsum(mask, dtype=np.int32) - 1
        return Rows(self.flat[keep], number[self.owner[keep]], int(mask.sum()), self.ids)


class Linear:
    """L1 logistic regression on binary features and a few dense columns."""

    def __init__(self, rows: Rows, dense: np.ndarray, y: np.ndarray):
        n, pos = len(y), float(y.sum())
        self.ids, self.w = np.zeros(0, np.int64), np.zeros(0)
        self.v, self.b = np.zeros(dense.shape[1]), -30.0 if pos == 0 else 30.0
        if pos in (0.0, float(n)):
            return
        df = counted(rows.flat, len(rows.ids))
        hit = counted(rows.flat[(y > 0)[rows.owner]], len(rows.ids))
        rate = df / n
        z = (hit / pos - (df - hit) / (n - pos)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / pos + 1 / (n - pos)))
        z = np.where(df >= LEAST_ROWS, np.abs(z), 0)
        chosen = np.argsort(-z, kind="stable")[:SELECTED]
        chosen = np.sort(chosen[z[chosen] >= 2])
        place = np.full(len(rows.ids), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        col = place[rows.flat]
        row, col = rows.owner[col >= 0], col[col >= 0]
        k = len(chosen)

        def ahead(w, v, b):
            return np.bincount(row, weights=w[col], minlength=n) + dense @ v + b

        def back(r):
            return np.bincount(col, weights=r[row], minlength=k), dense.T @ r, r.sum()

        x = (np.ones(k), np.ones(dense.shape[1]), 1.0)
        for _ in range(12):  # the largest curvature, by power iteration
            x = back(ahead(*x))
            norm = math.sqrt(sum(float(np.sum(np.square(p))) for p in x))
            x = tuple(p / norm for p in x)
        step = 4 * n / norm
        cur = old = (np.zeros(k), np.zeros(dense.shape[1]), math.log(pos / (n - pos)))
        t = 1.0
        for _ in range(STEPS):
            new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
            look = tuple(c + (t - 1) / new_t * (c - o) for c, o in zip(cur, old))
            g = back((sigmoid(ahead(*look)) - y) / n)
            w = look[0] - step * g[0]
            w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
            old, cur, t = cur, (w, look[1] - step * g[1], look[2] - step * g[2]), new_t
        live = cur[0] != 0
        self.ids, self.w, self.v, self.b = rows.ids[chosen[live]], cur[0][live], cur[1], float(cur[2])

    def odds(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        weight = np.zeros(len(rows.ids))
        weight[np.searchsorted(rows.ids, self.ids)] = self.w
        total = np.zeros(rows.n)
        for a in range(0, rows.n, ROWS):  # owners ascend: a row is summed up in one block
            lo, hi = np.searchsorted(rows.owner, (a, a + ROWS))
            n = min(ROWS, rows.n - a)
            total[a : a + n] = np.bincount(rows.owner[lo:hi] - a, weights=weight[rows.flat[lo:hi]], minlength=n)
        return total + dense @ self.v + self.b


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on to reject: most of the set rows caught, less ``WRONG_COST`` times the share of others.

    Of equal cuts that in the middle, between its neighbours' log-odds; 0.5 where all rows are alike.
    """
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    first = np.flatnonzero(np.r_[True, p[1:] > p[:-1]])  # a cut lies in front of the first of equals
    gain = (y.sum() - np.r_[0, np.cumsum(y)][first]) / y.sum() - WRONG_COST * ((1 - y).sum() - np.r_[0, np.cumsum(1 - y)][first]) / (1 - y).sum()
    best = first[np.flatnonzero(gain >= gain.max() - 1e-12)]
    at = int(best[len(best) // 2])
    return float(p[0]) if at == 0 else float(sigmoid((log_odds(p[at - 1]) + log_odds(p[at])) / 2))


class Chain:
    """Models of the categories in turn, the words' features that they weigh, and the cut of the deciding category."""

    def __init__(self, rows: Rows, y: np.ndarray, shift: np.ndarray, decides: int = 1):
        """y: rows x categories. shift: what to add to each category's log-odds, as the sample has its own shares."""
        self.models, before, self.shift = [], np.zeros((rows.n, 0)), shift
        folds = np.arange(rows.n) % FOLDS
        self.held_out = np.zeros(y.shape)
        for c in range(y.shape[1]):
            out = np.zeros(rows.n)
            for f in range(FOLDS):
                outside = folds == f
                if outside.any() and not outside.all():
                    m = Linear(rows.where(~outside), before[~outside], y[~outside, c])
                    out[outside] = m.odds(rows.where(outside), before[outside])
            self.models.append(Linear(rows, before, y[:, c]))
            self.held_out[:, c] = sigmoid(out + shift[c])
            before = np.column_stack([before, log_odds(self.held_out[:, c])])
        ids = np.unique(np.concatenate([m.ids for m in self.models])).astype(np.int64)
        self.place = {int(f): k for k, f in enumerate(ids)}
        self.weights = np.zeros((len(ids) + 1, len(self.models)))
        for c, m in enumerate(self.models):
            self.weights[np.searchsorted(ids, m.ids), c] = m.w
        self.dense = [(m.b + float(x), m.v.tolist()) for m, x in zip(self.models, shift)]
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.reject = best_cut(self.held_out[:, decides], y[:, decides])

    def __getstate__(self):
        return self.__dict__ | {"words": {}, "held_out": None}

    def probabilities(self, text: str | None) -> np.ndarray:
        known, place = self.words, self.place
        words = words_of(text)
        distinct = set(words)
        live: set[int] = set()
        for w in distinct:
            got = known.get(w)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = known[w] = tuple([place[f] for f in word_features(w) if f in place])
            if got:
                live.update(got)
        live.update(place[f] for f in text_features(text, len(words), len(distinct)) if f in place)
        z = self.weights.take(sorted(live), axis=0).sum(axis=0).tolist()
        odds: list[float] = []
        for c, (b, v) in enumerate(self.dense):
            odds.append(min(max(z[c] + b + sum(map(operator.mul, v, odds)), -MOST_ODDS), MOST_ODDS))
        return np.array([1 / (1 + math.exp(-o)) for o in odds])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple = CATEGORIES,
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Chain:
    """Fit the chain on at most ``sample_rows`` labelled rows of the deciding category and as many others.

    Labels without an id or without the deciding label are left out, and of an id labelled more than once the smallest. Of
    documents of one id that of the smallest text hash counts. Rows are taken in the order of a hash of their id, as long as
    their texts have ``sample_bytes`` together for each side; a text longer than that is not fitted on. The sample's features,
    not its texts, come to the driver. With nothing labelled every probability is next to 0.
    """
    deciding = dict(categories)[DECIDES]
    asked = [F.coalesce(F.expr(e), F.lit(False)).cast("int") for _, e in categories]
    known = labels.where(F.col(id_col).isNotNull() & F.expr(deciding).isNotNull())
    known = known.select(F.col(id_col).alias("doc_id"), F.expr(deciding).alias("d"), F.array(*asked).alias("y"))
    known = known.groupBy("doc_id").agg(F.min("d").alias("d"), F.min("y").alias("y"))
    some = [known.where(F.col("d") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for side in (True, False)]
    counts = {r["d"]: r["count"] for r in known.groupBy("d").count().collect()}
    # At most 2 * sample_rows ids and labels.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(some[0].union(some[1])), "doc_id").groupBy("doc_id", "d", "y")
    sample = sample.agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x")).select("doc_id", "d", "y", "x.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([features(t.as_py()) for t in b.column(3)], pa.list_(pa.int32()))
            size = pa.array([0 if not t.is_valid else t.as_buffer().size for t in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], size, made], names=["doc_id", "d", "y", "size", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = checkpoint(sample.mapInArrow(run, f"doc_id {kind}, d boolean, y array<int>, size long, f array<int>").where(F.col("size") <= sample_bytes))
    # At most 2 * sample_rows ids.
    upto = F.sum("size").over(Window.partitionBy("d").orderBy(F.xxhash64("doc_id"), "doc_id"))
    taken = made.select("doc_id", "d", "size").withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("doc_id")
    got = made.join(F.broadcast(taken), "doc_id", "left_semi").orderBy("doc_id").select("y", "f").toArrow()
    y, found = got["y"].to_pylist(), got["f"].combine_chunks()
    y = np.array(y, float).reshape(len(y), len(categories))
    flat, at = found.flatten().to_numpy(), found.offsets.to_numpy() if len(found) else np.zeros(1, int)
    rows = Rows.of(flat, np.repeat(np.arange(len(y), dtype=np.int32), np.diff(at)), len(y))
    # What came from Spark is not needed any more, and its memory is given back before the fit takes its own.
    del got, found, flat, at
    pa.default_memory_pool().release_unused()
    # The sample has its own share of the deciding category: odds are moved back to the share among all labels.
    d = [name for name, _ in categories].index(DECIDES)
    have, true = (y[:, d].mean() if len(y) else 0.5), counts.get(True, 0) / max(1, sum(counts.values()))
    moved = float(log_odds(true) - log_odds(have))
    shift = np.array([moved if DECIDES in name else 0.0 for name, _ in categories])
    return Chain(rows, y, shift, d)


def score(
    docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", categories: tuple = CATEGORIES
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, a probability p_<category> for each category, and rejected.

    Null and empty texts are scored as texts without a word, texts of any length by all their words. Repeated rows score alike.
    Other columns are not read. Of no rows come no rows.
    """
    get, names = shipped(docs.sparkSession, chain), [f"p_{n}" for n, _ in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.array([get().probabilities(t.as_py()) for t in b.column(1)]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p.T)], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("rejected", F.col(f"p_{DECIDES}") >= chain.reject)


def kept_rows(docs: DataFrame, chain: Chain, text_col: str = "text", categories: tuple = CATEGORIES) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, of any name; judged in place, without a shuffle.

    Null and empty texts are judged as texts without a word, texts of any length by all their words. Repeated rows stay or go
    together. Of no rows come no rows.
    """
    get, d = shipped(docs.sparkSession, chain), [n for n, _ in categories].index(DECIDES)

    @F.pandas_udf("boolean")
    def fine(texts):
        return texts.map(lambda t: get().probabilities(t)[d] < get().reject).astype(bool)

    return docs.where(fine(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def op1_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    """Probabilities and verdict for every document, with the chain fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
