"""Benchmark decontamination with a BM25 inverted index of the test items and block-max WAND.

The index holds the items; the training passages are the queries. Items are taken by length, in classes up to 16, 32, 64, ...
words, and the passages for a class are windows of twice so many words, moved by half their width: every item-long stretch
of a document lies whole in some passage, and a long item does not widen the passages of a short one. Impacts are BM25
scores, of counts over all items, divided by what the item scores against itself, so one threshold suits items of any length.
Items are laid out in small blocks, and for every term and block the largest impact is kept. All passages of a document are
first held against the sums of these maxima. Hardly a passage can reach the threshold in any block, and that is walked
document at a time by block-max WAND. Each item retrieved is verified on its words: the shingles of its question and of its
answer must both be in the passage.

A large benchmark makes several indexes, dealt by a hash of the item and built where the items are; each is a file in the shared
folder, and a worker holds as many as ``HELD_BYTES`` allow, so it reads each once; of a benchmark beyond that it reads the rest anew for every
``CHARS`` of documents. As an item's score and passages depend on no other item of its index, neither does any
result depend on how many there are.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, OrderedDict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint, filesystem, publish, table, work_dir

K1, B = 1.2, 0.75
#: Share of an item's own score from which a passage retrieves it, and share of shingles that verifies it.
RETRIEVE, VERIFY = 0.5, 0.8
SHINGLE = 5
#: Items in a block; bytes of item text in an index, on average; bytes of index files that a worker holds at once.
BLOCK = 2
INDEX_BYTES = 128 << 10
HELD_BYTES = 256 << 20
#: Block maxima are whole numbers of this fraction, rounded up.
UNITS = 1000
#: Words of the shortest class of items.
SHORTEST = 16
#: Characters of documents whose words are held at once.
CHARS = 1 << 21
#: Block sums that are made at once.
SUMS = 1 << 22
#: ASCII punctuation and capitals, for words that ignore both.
PLAIN = bytes.maketrans(
    b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * 32 + b"abcdefghijklmnopqrstuvwxyz"
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(PLAIN).split()


def parts_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: its last sentence is the answer, or its last quarter if it has one sentence."""
    text = (text or "").rstrip()
    cut = max((text.rfind(mark, 0, max(len(text) - 1, 0)) for mark in ".?!\n"), default=-1) + 1
    question, answer = words_of(text[:cut]), words_of(text[cut:])
    if not question or not answer:
        every = question + answer
        at = len(every) - -(-len(every) // 4)
        question, answer = every[:at], every[at:]
    return question, answer


def shingles(words: list, n: int = SHINGLE) -> set[tuple]:
    """The runs of n words; of fewer words the whole."""
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def width_of(n_words: int) -> int:
    """The most words of an item's class; its passages are twice as wide."""
    return max(SHORTEST, 1 << (n_words - 1).bit_length())


def passages_of(n_words: int, width: int) -> int:
    """How many passages a text of so many words has for a class."""
    return max(1, -(-n_words // width) - 1) if n_words else 0


class Shelf:
    """The items of one class in an index: postings of (ordinal, impact) for each term, and block maxima."""

    def __init__(self, items: list[tuple], width: int, idf: dict[bytes, float], mean: float, terms: dict[bytes, int], block: int):
        # Items that share their frequent words stand together, which keeps block maxima tight.
        count = Counter(w for _, q, a in items for w in set(q + a))
        items = sorted(items, key=lambda x: (sorted({*x[1], *x[2]}, key=lambda w: (-count[w], w))[:3], str(x[0]), x[1:]))
        self.width, self.block, self.ids = width, block, [i for i, _, _ in items]
        self.wanted = [(shingles(q), shingles(a)) for _, q, a in items]
        own_terms = sorted(count)
        self.local = np.full(len(terms), -1, np.int32)
        self.local[[terms[w] for w in own_terms]] = np.arange(len(own_terms))
        number = {w: k for k, w in enumerate(own_terms)}
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in own_terms]
        self.block_max = np.zeros((len(own_terms), -(-len(items) // block)), np.uint32)
        for d, (_, q, a) in enumerate(items):
            n = len(q) + len(a)
            raw = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for w, f in Counter(q + a).items()}
            own = math.fsum(raw.values())
            for w, x in raw.items():
                k = number[w]
                self.postings[k][0].append(d)
                self.postings[k][1].append(x / own)
                self.block_max[k, d // block] = max(self.block_max[k, d // block], math.ceil(x / own * UNITS))
        self.max = self.block_max.max(axis=1, initial=0) / UNITS

    def search(self, ids: list[int], least: float) -> list[tuple[int, float]]:
        """All (item ordinal, score) of at least ``least`` for the distinct term ids of a passage, by block-max WAND."""
        lists = [[*self.postings[k], self.block_max[k], float(self.max[k]), 0] for k in ids]
        out, slack = [], least - 1e-6
        while lists:
            lists.sort(key=lambda x: x[0][x[4]])
            bound = 0.0
            for p, x in enumerate(lists):
                bound += x[3]
                if bound >= slack:
                    break
            else:
                break
            pivot = lists[p][0][lists[p][4]]
            while p + 1 < len(lists) and lists[p + 1][0][lists[p + 1][4]] == pivot:
                p += 1
            b = pivot // self.block
            if sum(int(x[2][b]) for x in lists[: p + 1]) < slack * UNITS:
                # No item up to the block's end, or up to the next list's item, can reach the threshold.
                to = (b + 1) * self.block
                if p + 1 < len(lists):
                    to = min(to, lists[p + 1][0][lists[p + 1][4]])
            elif lists[0][0][lists[0][4]] == pivot:
                score = math.fsum(x[1][x[4]] for x in lists[: p + 1])
                if score >= slack:
                    out.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for x in lists[: p + 1]:
                docs, at = x[0], x[4]
                while at < len(docs) and docs[at] < to:
                    at += 1
                x[4] = at
            lists = [x for x in lists if x[4] < len(x[0])]
        return out

    def reach(self, t: np.ndarray, s: np.ndarray, fresh: np.ndarray, again: np.ndarray, first: int, last: int, least: float) -> np.ndarray:
        """Which passages from ``first`` to before ``last`` may hold an item, of terms t in steps s.

        A passage is two steps; a term counts once: where it is new to its step, less where the step before has it too.
        """
        starts = np.searchsorted(s, np.arange(first, last + 2))
        sums = []
        for use in (fresh, again):
            at = starts[0] + np.flatnonzero(use[starts[0] : starts[-1]])
            cut = np.searchsorted(at, starts)
            into = np.zeros((last - first + 1, self.block_max.shape[1]), np.uint32)
            if len(at):
                full = np.flatnonzero(cut[1:] > cut[:-1])
                into[full] = np.add.reduceat(self.block_max.take(t[at], axis=0), cut[full], axis=0, dtype=np.uint32)
            sums.append(into)
        n = last - first
        return first + np.flatnonzero((sums[0][:n] + sums[0][1 : n + 1] - sums[1][1 : n + 1] >= int(least * UNITS)).any(axis=1))

    def hits(self, words: list[bytes], ids: np.ndarray, retrieve: float, verify: float, found: dict) -> int:
        """Items retrieved for all passages of a text, by the index's term ids of its words; ``found`` gets those verified."""
        at = np.flatnonzero(ids >= 0)
        t = self.local[ids[at]]
        at, t = at[t >= 0], t[t >= 0]
        if not at.size:
            return 0
        width, passages = self.width, passages_of(len(words), self.width)
        s = at // width
        order = np.argsort(t, kind="stable")
        gap = np.full(len(t), passages + 3)
        same = np.flatnonzero(t[order][1:] == t[order][:-1])
        gap[order[same + 1]] = s[order[same + 1]] - s[order[same]]  # steps since the term came last
        fresh, again, retrieved = gap >= 1, gap == 1, 0
        some = max(1, SUMS // (width * max(1, self.block_max.shape[1])))
        for first in range(0, passages, some):
            for p in self.reach(t, s, fresh, again, first, min(passages, first + some), retrieve).tolist():
                a, z = np.searchsorted(s, (p, p + 2))
                got = self.search(np.unique(t[a:z]).tolist(), retrieve)
                retrieved += len(got)
                if not got:
                    continue
                window = words[p * width : (p + 2) * width]
                there = {k: shingles(window, k) for k in {len(x) for d, _ in got for part in self.wanted[d] for x in part}}
                for d, score in got:
                    shares = [sum(x in there[len(x)] for x in part) / len(part) if part else 1.0 for part in self.wanted[d]]
                    if min(shares) >= verify:
                        item = self.ids[d]
                        found[item] = max(found.get(item, (0.0,)), (score, *shares))
        return retrieved


class Index:
    """Inverted BM25 index of (item_id, text), by classes of length. Items without a word are in no index.

    ``counts`` has the number of all items with a word, their mean length, and how many of them have each word; by default
    these are counted over the given items.
    """

    def __init__(self, items: list[tuple], counts: tuple[int, float, dict[bytes, int]] | None = None, block: int = BLOCK):
        kept = [x for x in ((i, *parts_of(t)) for i, t in items) if x[1] or x[2]]
        if counts is None:
            df = Counter(w for _, q, a in kept for w in set(q + a))
            counts = len(kept), sum(len(q) + len(a) for _, q, a in kept) / max(1, len(kept)), df
        n, mean, df = counts
        self.terms = {w: k for k, w in enumerate(sorted({w for _, q, a in kept for w in q + a}))}
        idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in self.terms}
        classes: dict[int, list[tuple]] = {}
        for x in kept:
            classes.setdefault(width_of(len(x[1]) + len(x[2])), []).append(x)
        self.shelves = [Shelf(x, w, idf, mean, self.terms, block) for w, x in sorted(classes.items())]

    def hits(self, words: list[bytes], retrieve: float = RETRIEVE, verify: float = VERIFY) -> tuple[int, dict]:
        """Items retrieved for the passages of a text, and {item_id: (score, question share, answer share)} of those verified."""
        found: dict = {}
        if not words:
            return 0, found
        ids = np.array([*map(self.terms.get, words, repeat(-1))], np.int32)
        return sum(shelf.hits(words, ids, retrieve, verify, found) for shelf in self.shelves), found


class Indexes:
    """The indexes of all items, as files; those used last are held, ``HELD_BYTES`` of them at most, but one always."""

    def __init__(self, folder: str, names: list[str], widths: list[int]):
        self.folder, self.names, self.widths, self.held = folder, names, widths, OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"held": OrderedDict()}

    def read(self, name: str) -> tuple[Index, int]:
        """An index and the size of its file."""
        fs, root = filesystem(self.folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            data = f.read()
        return pickle.loads(data), len(data)

    def __iter__(self) -> Iterator[Index]:
        # Those still held first: with more files than places, every turn then reads some less.
        for name in sorted(self.names, key=lambda n: n not in self.held):
            if name not in self.held:
                made, size = self.read(name)
                while self.held and sum(n for _, n in self.held.values()) + size > HELD_BYTES:
                    self.held.popitem(last=False)
                self.held[name] = made, size
            yield self.held[name][0]

    def judge(self, texts: list[str | None], retrieve: float, verify: float) -> tuple[list[int], list[int], list[dict]]:
        """Of each text the number of passages, over all classes, of items retrieved, and the items verified with their shares."""
        passages, retrieved, found = [0] * len(texts), [0] * len(texts), [{} for _ in texts]
        first = 0
        while first < len(texts):
            # So many texts at once as their words may be held; a longer one by itself.
            words, size = [], 0
            while first + len(words) < len(texts) and (not words or size + len(texts[first + len(words)] or "") <= CHARS):
                size += len(texts[first + len(words)] or "")
                words.append(words_of(texts[first + len(words)]))
            for index in self:
                for i, w in enumerate(words, first):
                    n, got = index.hits(w, retrieve, verify)
                    retrieved[i] += n
                    for item, x in got.items():
                        found[i][item] = max(found[i].get(item, (0.0,)), x)
            for i, w in enumerate(words, first):
                passages[i] = sum(passages_of(len(w), width) for width in self.widths)
            first += len(words)
        return passages, retrieved, found


def build(items: DataFrame, id_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> Indexes:
    """Index all items; each index is built by a task and written to the shared folder.

    Ids may be null and of any type that Arrow has. Items without a word are in no index. Repeated items count each. A single long
    item makes its index as large as it needs. Of no items come no indexes.
    """
    spark = items.sparkSession
    src = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t.as_py()) for t in b.column(1)]
            n, distinct = pa.array(map(len, words), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, n, distinct], names=["id", "text", "n", "words"])

    parsed = src.mapInArrow(parse, f"id {items.schema[id_col].dataType.simpleString()}, text string, n long, words array<binary>").where("n > 0")
    total = parsed.agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not total.items:
        return Indexes("", [], [])
    slices = -(-total.bytes // index_bytes)
    parsed = checkpoint(parsed.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(slices))))
    widths = sorted({width_of(r.n) for r in parsed.select("n").distinct().collect()})  # one row for each length of an item
    held = parsed.select("slice", F.explode("words").alias("word"))
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    df = held.distinct().join(df, "word").groupBy("slice").agg(F.collect_list(F.struct("word", "df")).alias("df"))
    rows = parsed.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("items")).join(df, "slice")
    folder, n_items, mean = work_dir(spark, "indexes"), total["items"], total["mean"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = []
            for part, some, df in zip(*(c.to_pylist() for c in b.columns)):
                index = Index([(x["id"], x["text"]) for x in some], (n_items, mean, {x["word"]: x["df"] for x in df}))
                names.append(f"{part:08d}.index")
                publish(folder, names[-1], cloudpickle.dumps(index))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    made = rows.select("slice", "items", "df").mapInArrow(write, "name string")
    return Indexes(folder, sorted(r.name for r in made.collect()), widths)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    retrieve: float = RETRIEVE,
    verify: float = VERIFY,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_passages, n_retrieved, n_items, item_ids (sorted), best_score, contaminated.

    Null and empty texts have no passage and are clean, as is every text if there are no items or none with a word. Items of
    equal text are all reported; item_ids have the items' type, and a null one comes last. n_passages counts the passages of every class of items.
    Repeated rows are each judged. Very long texts are held against the block maxima in slices. Other columns are not read.
    """
    kind, indexes = docs.schema[id_col].dataType.simpleString(), build(items, index_bytes=index_bytes)
    item, item_kind = (f(items.schema["item_id"].dataType) for f in (lambda t: t.simpleString(), to_arrow_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            passages, retrieved, found = indexes.judge([t.as_py() for t in b.column(1)], retrieve, verify)
            every, best = [[*sorted(x.keys() - {None}), *([None] if None in x else [])] for x in found], [max((s[0] for s in x.values()), default=0.0) for x in found]
            kinds = (pa.int64(), pa.int64(), pa.list_(item_kind), pa.float64())
            columns = [b.column(0), *map(pa.array, (passages, retrieved, every, best), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_passages", "n_retrieved", "item_ids", "best_score"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = src.mapInArrow(run, f"doc_id {kind}, n_passages long, n_retrieved long, item_ids array<{item}>, best_score double")
    n = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_passages", "n_retrieved", n.alias("n_items"), "item_ids", "best_score", (n > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; judged in place, without a shuffle.

    Null and empty texts stay, as does every row if there are no items; repeated rows stay or go together. Other columns may
    have any name. Texts of any length are judged whole. Of no rows come no rows.
    """
    indexes = build(items)

    @F.pandas_udf("boolean")
    def clean(texts):
        return pd.Series([not x for x in indexes.judge(list(texts), RETRIEVE, VERIFY)[2]], dtype=bool)

    return docs.where(clean(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
