"""A recogniser that is learned: a linear-chain tagger, fitted by averaged perceptrons on texts with marked spans.

A text's tokens get tags, begin or inside of a label or outside of all, by the best sequence under the weights of hashed features and of
neighbouring tags (Viterbi). Training mixes parameters: in every round each part of the texts, all of them, starts from the same weights, goes through its
texts, and what the parts have learned is averaged, by Spark, feature by feature. So it stands in for a zero-shot model where there is none: fitted on spans that patterns
mark, it finds their like by shape and context.
"""

from __future__ import annotations

import itertools
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpoint
from .detect import CHUNK_KEY, Detector
from .replace import highlight_spans

#: The fewest parts that the texts of a fit are dealt to, texts of a part where there are more of them, and rounds.
PARTS, PART_TEXTS, ROUNDS = 4, 1000, 5
#: Texts and tokens that are tagged at once.
AT_ONCE, TOKENS_AT_ONCE = 256, 1 << 15
#: Means over a part's steps are summed in units of 1 / ``UNITS``, so that no sum depends on its order.
UNITS = 1 << 20
#: Rows of weights that features are hashed to, and labels that a model may have.
FEATURES, MOST_LABELS = 1 << 15, 40
NEVER = -1e9
TOKEN = re.compile(r"\w+|[^\w\s]")
NAMES = ("first name", "last name", "name", "person")


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def kind(c: str) -> str:
    return "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c


ASCII_KINDS, LONG_RUN = {i: kind(chr(i)) for i in range(128)}, re.compile(r"(.)\1{3,}")


def shape(word: str) -> str:
    """Upper and lower case letters, digits and others, runs at most four long."""
    kinds = word.translate(ASCII_KINDS) if word.isascii() else "".join(map(kind, word))
    return LONG_RUN.sub(r"\1\1\1\1", kinds) if len(kinds) > 4 else kinds


def hashes(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode("utf-8", "replace")) for x in names], np.int64) % FEATURES


def features(texts: list[tuple[str, list[tuple[int, int]]]]) -> list[np.ndarray]:
    """Rows of weights for each token of each text: its word, shape, ends and length, and its neighbours'. What texts share is hashed once."""
    known: dict[str, int] = {}
    edge = [known.setdefault(w, len(known)) for w in ("<s>", "</s>")]
    ids, ends = [], []
    for text, spans in texts:
        ids += [edge[0]] * 2 + [known.setdefault(text[a:b], len(known)) for a, b in spans] + [edge[1]] * 2
        ends.append(len(ids))
    at = np.array(ids, np.int64)
    low, shapes = [w.lower() for w in known], [shape(w) for w in known]

    def names(key: list[str], *each) -> list[np.ndarray]:
        return [hashes([f(x) for x in key])[at] for f in each]

    word, start, end, size, *near = names(low, "w={}".format, lambda w: f"p={w[:3]}", lambda w: f"e={w[-3:]}", lambda w: f"n={min(len(w), 12)}", *(f"w{d}={{}}".format for d in (-2, -1, 1, 2)))
    form, before, behind = names(shapes, *(f"s{d}={{}}".format for d in ("", -1, 1)))
    number = [{x: i for i, x in enumerate(dict.fromkeys(each))} for each in (low, shapes)]
    lows, forms = (np.array([n[x] for x in each], np.int64)[at] for n, each in zip(number, (low, shapes)))
    low_of, form_of = (list(n) for n in number)

    def pairs(kind: str, first: np.ndarray, first_of: list[str]) -> np.ndarray:
        """Of each place with the shape behind it; the last place has none."""
        every, where = np.unique(first[:-1] * len(form_of) + forms[1:], return_inverse=True)
        return hashes([f"{kind}={first_of[x // len(form_of)]} {form_of[x % len(form_of)]}" for x in every.tolist()])[where]

    ss, st, ws = pairs("ss", forms, form_of), pairs("st", forms, form_of), pairs("ws", lows, low_of)
    bias, out, begin = hashes(["b"])[0], [], 0
    for (_, spans), stop in zip(texts, ends):
        i = np.arange(begin + 2, stop - 2)
        near_i = [near[0][i - 2], near[1][i - 1], near[2][i + 1], near[3][i + 2], before[i - 1], behind[i + 1]]
        out.append(np.stack([word[i], form[i], start[i], end[i], size[i], np.full(len(i), bias), *near_i, ss[i - 1], st[i], ws[i - 1]], axis=1))
        begin = stop
    return out


def tags_of(labels: list[str]) -> list[tuple[str, str]]:
    return [("O", ""), *((k, x) for x in labels for k in "BI")]


def allowed(tags: list[tuple[str, str]]) -> np.ndarray:
    """What is added to a step from one tag to the next: the inside of a label follows only its beginning or inside. The last row is the start."""
    ok = np.zeros((len(tags) + 1, len(tags)))
    for j, (kind, label) in enumerate(tags):
        if kind == "I":
            ok[:, j] = NEVER
            ok[[i for i, t in enumerate(tags) if t[0] != "O" and t[1] == label], j] = 0
    return ok


def best_path(emit: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The tags of the highest sum of ``emit[i, tag]`` and ``steps[tag before, tag]``; the last row of steps is the start's. Of equals the first."""
    n, k = emit.shape
    if not n:
        return np.zeros(0, np.int64)
    back = np.zeros((n, k), np.int64)
    score = emit[0] + steps[k]
    for i in range(1, n):
        every = score[:, None] + steps[:k]
        back[i] = every.argmax(axis=0)
        score = every[back[i], np.arange(k)] + emit[i]
    path = np.zeros(n, np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def emitted(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[rows[:, 0]]
    for j in range(1, rows.shape[1]):
        out += weights[rows[:, j]]
    return out


def best_paths(emits: list[np.ndarray], steps: np.ndarray) -> list[np.ndarray]:
    """``best_path`` of each text, all of them step by step together."""
    k, order = steps.shape[1], sorted(range(len(emits)), key=lambda t: -len(emits[t]))
    order = [t for t in order if len(emits[t])]
    out = [np.zeros(len(e), np.int64) for e in emits]
    if not order:
        return out
    sizes = np.array([len(emits[t]) for t in order])
    most, to = sizes[0], np.ascontiguousarray(steps[:k].T)
    emit = np.zeros((most, len(order), k))
    for j, t in enumerate(order):
        emit[: sizes[j], j] = emits[t]
    back, score = np.zeros((most, len(order), k), np.int8), emit[0] + steps[k]
    for i in range(1, most):
        n = int(np.searchsorted(-sizes, -i))  # texts longer than i
        every = score[:n, None, :] + to
        back[i, :n] = every.argmax(axis=2)
        score[:n] = every.max(axis=2) + emit[i, :n]
    now, path = score.argmax(axis=1), np.zeros((most, len(order)), np.int64)
    for i in range(most - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -i))
        path[i, :n] = now[:n]
        if i:
            now[:n] = back[i, np.arange(n), now[:n]]
    for j, t in enumerate(order):
        out[t] = path[: sizes[j], j].copy()
    return out


def batches_of(sizes: list[int], start: int, most: int) -> int:
    """Where a batch of at most ``most`` texts that begins at ``start`` ends; one text at least, and no more tokens than are tagged at once beyond it."""
    end, tokens = start + 1, sizes[start]
    while end < min(len(sizes), start + most) and tokens + sizes[end] <= TOKENS_AT_ONCE:
        tokens += sizes[end]
        end += 1
    return end


@dataclass(frozen=True)
class Tagger:
    """``weights`` has a row for each hashed feature, then one for each tag before and one for the start; a column for each tag."""

    labels: tuple[str, ...]
    weights: np.ndarray

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of what is found, in order; the score grows with how far the tags are ahead, from 0.5 to 1."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """``spans`` of each text."""
        out, begin = [], 0
        if not self.labels:
            return [[] for _ in texts]
        steps = self.weights[FEATURES:] + allowed(tags_of(list(self.labels)))
        places = [tokens_of(t) for t in texts]
        sizes = [len(p) for p in places]
        while begin < len(texts):
            end = batches_of(sizes, begin, AT_ONCE)
            emits = [emitted(self.weights, rows) for rows in features([*zip(texts[begin:end], places[begin:end])])]
            out += [self._marked(*x) for x in zip(places[begin:end], emits, best_paths(emits, steps))]
            begin = end
        return out

    def _marked(self, where: list[tuple[int, int]], emit: np.ndarray, path: np.ndarray) -> list[tuple[int, int, str, float]]:
        tags, found = tags_of(list(self.labels)), []
        for i in np.flatnonzero(path).tolist():
            t = int(path[i])
            kind, label = tags[t]
            ahead = float(emit[i, t] - np.delete(emit[i], t).max())
            if kind == "B":
                found.append([*where[i], label, [ahead]])
            else:
                found[-1][1] = where[i][1]
                found[-1][3].append(ahead)
        return [(a, b, label, round(0.5 + 0.5 / (1 + np.exp(-float(np.mean(m)))) ** 2, 4)) for a, b, label, m in found]


def gold(text: str, where: list[tuple[int, int]], spans: list[dict], tags: list[tuple[str, str]]) -> np.ndarray:
    """The tags that marked spans (start, end, label) give the tokens inside of them; of overlapping ones the first that begins."""
    at, out, end = {t: i for i, t in enumerate(tags)}, np.zeros(len(where), np.int64), 0
    starts, ends = [a for a, _ in where], [b for _, b in where]
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        mine = range(bisect_left(starts, max(s["start"], end)), bisect_right(ends, s["end"]))
        if mine and ("B", s["label"]) in at:
            out[mine] = at["I", s["label"]]
            out[mine[0]] = at["B", s["label"]]
            end = s["end"]
    return out


def learn(texts: list[tuple[str, list[dict]]], tags: list[tuple[str, str]], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a perceptron that goes through the texts from ``start`` on changes, and the sum of its changes over all steps; whole numbers.

    Texts are tagged many at once. Up to the first that is tagged wrong nothing changes, and those behind it are tagged again: so each is
    tagged by the weights of its step.
    """
    k, steps_ok = len(tags), allowed(tags)
    weights, change, weighed = start.copy(), np.zeros(start.shape, np.int64), np.zeros(start.shape, np.int64)
    places = [tokens_of(text) for text, _ in texts]
    rows = features([(text, where) for (text, _), where in zip(texts, places)])
    want = [gold(text, where, spans, tags) for (text, spans), where in zip(texts, places)]
    sizes, begin, most = [len(p) for p in places], 0, 8
    while begin < len(texts):
        end = batches_of(sizes, begin, most)
        got = best_paths([emitted(weights, r) for r in rows[begin:end]], weights[FEATURES:] + steps_ok)
        wrong = next((j for j, path in enumerate(got) if not np.array_equal(path, want[begin + j])), None)
        if wrong is None:
            begin, most = end, min(2 * most, AT_ONCE)
            continue
        step, path = begin + wrong, got[wrong]
        differs = np.flatnonzero(path != want[step])
        at = rows[step][differs]
        for of, by in ((want[step], 1), (path, -1)):
            before = FEATURES + np.r_[k, of[:-1]]
            for table, size in ((weights, by), (change, by), (weighed, by * (len(texts) - step))):
                np.add.at(table, (at, of[differs][:, None]), size)
                np.add.at(table, (before, of), size)
        begin, most = step + 1, max(8, wrong + 1)
    return change, weighed


def marked(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, chunk, spans): ``chunks`` with where the values of ``found(doc_id, chunk_index, text, label)`` stand."""
    values = found.groupBy(*CHUNK_KEY).agg(F.sort_array(F.collect_set(F.struct(F.col("text").alias("value"), F.col("label").alias("pii_type")))).alias("values"))
    rows = chunks.select(*CHUNK_KEY, "chunk").join(values, CHUNK_KEY, "left")
    none = F.array().cast("array<struct<value:string,pii_type:string>>")
    spans = highlight_spans(F.coalesce("chunk", F.lit("")), F.coalesce("values", none))
    return rows.select(*CHUNK_KEY, "chunk", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["pii_type"].alias("label"))).alias("spans"))


def fit(texts: DataFrame, parts: int = PARTS, rounds: int = ROUNDS) -> Tagger:
    """A tagger of ``texts(doc_id, chunk_index, chunk, spans)``, of all of them; reruns agree, however the rows lie.

    There are as many parts as the texts need, ``parts`` at least, dealt by a hash of the key; a task holds one part at a time.
    Null texts count for nothing. Without a span there are no labels, and nothing is found. More than ``MOST_LABELS`` labels are an error.
    """
    spark = texts.sparkSession
    rows = texts.where("chunk IS NOT NULL").select(F.xxhash64(F.lit("tagger"), *CHUNK_KEY).alias("at"), "chunk", "spans")
    labels = sorted(r[0] for r in rows.select(F.explode("spans.label").alias("label")).distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    tags = tags_of(labels)
    k = len(tags)
    weights, mean = np.zeros((FEATURES + k + 1, k)), np.zeros((FEATURES + k + 1, k))
    if not labels:
        return Tagger((), weights)
    parts = max(parts, -(-rows.count() // PART_TEXTS))
    tasks = min(parts, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int"))
    dealt = checkpoint(rows.repartition(tasks, "part").sortWithinPartitions("part", "at", "chunk", "spans").select("part", "chunk", "spans"))
    names = [f"{w}{i}" for w in "we" for i in range(k)]
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(weights)  # ``FEATURES`` rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE))  # few at a time become Python's
            each = (row for b in some for row in zip(*(c.to_pylist() for c in b.columns)))
            total, n = [np.zeros(held.value.shape, np.int64) for _ in range(2)], 0
            for _, mine in itertools.groupby(each, lambda x: x[0]):
                mine = [(chunk, spans or []) for _, chunk, spans in mine]
                change, weighed = learn(mine, tags, held.value)
                total[0] += change
                total[1] += np.rint(weighed * (UNITS / len(mine))).astype(np.int64)
                n += 1
            some = np.flatnonzero(total[0].any(axis=1) | total[1].any(axis=1))
            columns = [pa.array(some), pa.array(np.zeros(len(some), np.int64)), *(pa.array(np.ascontiguousarray(w[some, i])) for w in total for i in range(k))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", *names])
            # A row of its own for how many parts there were.
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, n, *[0] * (2 * k))], names=["row", "n", *names])

        learned = dealt.mapInArrow(run, "row long, n long, " + ", ".join(f"{c} long" for c in names))
        got = learned.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toArrow()
        at, n = got.column(0).to_numpy(), max(1, sum(got.column(1).to_pylist()))
        change = np.stack([c.to_numpy() for c in got.columns[2:]], axis=1)[at >= 0] / n
        at = at[at >= 0]
        mean += weights / rounds
        np.add.at(mean, at, change[:, k:] / UNITS / rounds)
        np.add.at(weights, at, change[:, :k])
        held.unpersist()
    return Tagger(tuple(labels), mean.round(6))


class TaggerDetector(Detector):
    """A fitted tagger as a detector; ``labels`` names its labels as ours. Neighbouring parts of a name are one person."""

    setting = "zero_shot_threshold"

    def __init__(self, model: Tagger, labels: dict[str, str] | None = None, name: str = "gliner_xlarge", ord: int = 1):
        self.model, self.labels, self.name, self.ord = model, labels or {}, name, ord

    def detect(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        out = []
        for text, spans in zip(texts, self.model.spans_of(texts)):
            found: list[list] = []
            for a, b, label, score in spans:
                label = self.labels.get(label, label)
                if found and label in NAMES and found[-1][2] in NAMES and text[found[-1][1] : a].strip() == "" and "\n" not in text[found[-1][1] : a]:
                    found[-1][1:] = [b, "person", max(score, found[-1][3])]
                else:
                    found.append([a, b, label, score])
            best: dict[tuple[str, str], float] = {}
            for a, b, label, score in found:
                best[text[a:b], label] = max(score, best.get((text[a:b], label), 0.0))
            out.append([(t, label, score) for (t, label), score in best.items()])
        return out


def span_scores(texts: DataFrame, model: Tagger) -> DataFrame:
    """(label, marked, found, right) over ``texts(chunk, spans)``: spans that are there, that the model finds, and that are both, to the character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list[int]] = {}
        for b in batches:
            texts, marks = (c.to_pylist() for c in b.columns)
            for spans, found in zip(marks, model.spans_of([t or "" for t in texts])):
                have = {(s["start"], s["end"], s["label"]) for s in spans or ()}
                got = {(a, e, label) for a, e, label, _ in found}
                for i, each in enumerate((have, got, have & got)):
                    for x in each:
                        rows.setdefault(x[2], [0, 0, 0])[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *(pa.array([r[i] for r in rows.values()], pa.int64()) for i in range(3))], names=["label", "marked", "found", "right"])

    seen = texts.select("chunk", "spans").mapInArrow(run, "label string, marked long, found long, right long")
    return seen.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("marked", "found", "right")))


def held_out(texts: DataFrame, folds: int = 5, **settings) -> DataFrame:
    """(label, marked, found, right, recall, precision) on one fold of the texts, by a hash of their key, of a model of the others."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), *CHUNK_KEY), F.lit(folds))
    texts = checkpoint(texts.withColumn("fold", fold))
    model = fit(texts.where("fold != 0"), **settings)
    rate = lambda whole: F.when(F.col(whole) > 0, F.round(F.col("right") / F.col(whole), 6)).otherwise(F.lit(0.0))
    return span_scores(texts.where("fold = 0"), model).withColumns({"recall": rate("marked"), "precision": rate("found")})
