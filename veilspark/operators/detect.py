"""Detectors: chunks in, detections out.

Detections are long-form rows: doc_id, chunk_index, detector, detector_ord, pos, text, label, score. Built-in detectors are
patterns. A model is a ``Detector`` whose ``detect`` takes a list of texts; it runs in ``mapInArrow``, loaded once a worker.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions import vocab
from ..workers.calls import outcome

CHUNK_KEY = ["doc_id", "chunk_index"]
DETECTION = ["doc_id", "chunk_index", "detector", "detector_ord", "pos", "text", "label", "score"]


def chunks(docs: DataFrame, size: int = 1600, overlap: int = 200, most: int | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, chunk): overlapping slices, numbered from 1; at most ``most`` a document where that is given."""
    made = tx.chunk_array(F.col(text_col), size, overlap)
    made = F.slice(made, 1, most) if most else made
    pos = docs.select("doc_id", F.posexplode(made).alias("pos", "chunk"))
    return pos.select("doc_id", (F.col("pos") + 1).alias("chunk_index"), "chunk")


def spans(chunk: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(chunk, F.lit(f"({pattern})" if not pattern.startswith("(?") else _grouped(pattern)), 1)


def _grouped(pattern: str) -> str:
    flags, rest = pattern.split(")", 1)
    return f"{flags})({rest})"


def dictionary_word(span: Column) -> Column:
    """A word of letters only and at most 22 of them: no opaque token."""
    return span.rlike(r"^[A-Za-z]+$") & (F.length(span) <= 22)


def audit_spans(chunk: Column, name: str) -> Column:
    """Matches of one audit pattern; the alphanumeric one leaves plain words out."""
    found = spans(chunk, vocab.AUDIT[name])
    return F.filter(found, lambda x: ~dictionary_word(x)) if name == "alphanumeric" else found


def entropy_tokens(chunk: Column, shortest: int = 16, least: float = 3.5) -> Column:
    """Tokens, without punctuation at their ends, that are long and random."""
    # Trimming only shortens.
    tokens = F.filter(F.split(tx.collapse(chunk), " "), lambda x: F.length(x) >= shortest)
    clean = F.transform(tokens, lambda x: F.btrim(x, F.lit(vocab.TOKEN_EDGES)))
    return F.filter(clean, lambda x: (F.length(x) >= shortest) & (tx.entropy(x) >= least))


def audit(df: DataFrame, text_col: str = "chunk", key: list[str] = CHUNK_KEY) -> DataFrame:
    """(key, text): the distinct suspicious tokens of every text.

    Texts without a digit, a long run of word characters or something like an address are not searched for patterns.
    """
    return df.select(*key, F.explode(audit_tokens(F.col(text_col))).alias("text"))


def audit_tokens(c: Column) -> Column:
    """The distinct suspicious tokens of one text."""
    maybe = c.rlike(r"(?Ui)\d|[A-Za-z0-9+/]{12}|at|@|\.")
    every = F.flatten(F.array(*(audit_spans(c, n) for n in vocab.AUDIT)))
    found = F.array_union(F.when(maybe, every).otherwise(F.array().cast("array<string>")), entropy_tokens(c))
    return F.array_distinct(found)


def indian_ids(df: DataFrame, text_col: str = "chunk", key: list[str] = CHUNK_KEY) -> DataFrame:
    """(key, text, label, score 1): ids by structure, the first spelling of each value and label."""
    found = id_spans(F.col(text_col))
    return indian_ids_of(df.select(*key, F.explode(found).alias("x")).select(*key, "x.*"), key)


def ruled(c: Column, rules: list[tuple[str, str, float]]) -> Column:
    """Matches of rules (pattern, label, score) in a text, as structs of rule, i, text, label and score, in the order of the rules; none of a null text."""

    def rule(o: int, pattern: str, label: str, score: float) -> Column:
        def row(x: Column, i: Column) -> Column:
            return F.struct(F.lit(o).alias("rule"), i.alias("i"), tx.strip(x).alias("text"), F.lit(label).alias("label"), F.lit(score).alias("score"))

        return F.transform(spans(c, pattern), row)

    return F.concat(*(rule(o, *r) for o, r in enumerate(rules)))


def id_spans(c: Column) -> Column:
    return ruled(c, [(p, label, 1.0) for p, label in vocab.INDIAN_IDS])


def indian_ids_of(found: DataFrame, key: list[str] = CHUNK_KEY) -> DataFrame:
    """``indian_ids`` of their matches ``found(key, rule, i, text, label)``."""
    found = found.groupBy(*key, F.lower("text").alias("low"), "label").agg(F.min_by("text", F.struct("rule", "i")).alias("text"))
    return found.select(*key, "text", "label", F.lit(1.0).alias("score"))


def supplement(df: DataFrame, known: DataFrame | None = None, text_col: str = "chunk", key: list[str] = CHUNK_KEY) -> DataFrame:
    """(key, text, label, score, rule): spans of the supplementary patterns that ``known(key, text)`` does not have.

    A span counts under the first rule that finds it, in any case, and where it stands first.
    """
    found = df.select(*key, F.explode(ruled(F.col(text_col), vocab.SUPPLEMENT)).alias("x"))
    return supplement_of(found, known, key)


def supplement_of(found: DataFrame, known: DataFrame | None = None, key: list[str] = CHUNK_KEY) -> DataFrame:
    """``supplement`` of the patterns' matches ``found(key, x)``, as ``ruled`` gives them."""
    found = found.withColumn("low", F.lower("x.text"))
    found = found.groupBy(*key, "low").agg(F.min("x").alias("x"))
    if known is not None:
        found = found.join(known.select(*key, F.lower(tx.strip(F.col("text"))).alias("low")), [*key, "low"], "left_anti")
    return found.select(*key, "x.text", "x.label", "x.score", "x.rule")


def recognise(df: DataFrame, name: str, text_col: str = "chunk", key: list[str] = CHUNK_KEY) -> DataFrame:
    """(key, text, label, score) of one built-in recogniser, each value once."""
    raw, pattern, score = vocab.RECOGNISERS[name]
    found = df.select(*key, F.explode(F.array_distinct(spans(F.col(text_col), pattern))).alias("text"))
    if name == "card":
        found = found.where(tx.luhn(F.col("text")))
    return found.select(*key, "text", lb.shared_label_or_spelled(F.lit(raw)).alias("label"), F.lit(score).alias("score"))


def recognise_all(df: DataFrame, text_col: str = "chunk", key: list[str] = CHUNK_KEY) -> DataFrame:
    """(key, text, label, score) of all built-in recognisers, in one pass over the texts; each recogniser has a value once."""
    rows = df.select(*key, F.explode(recogniser_spans(F.col(text_col))).alias("x"))
    return rows.select(*key, "x.text", "x.label", "x.score")


def recogniser_spans(c: Column) -> Column:
    """What the built-in recognisers find in a text, as ``ruled`` gives matches; each a value once."""

    def of(o: int, name: str, raw: str, pattern: str, score: float) -> Column:
        found = F.array_distinct(spans(c, pattern))
        found = F.filter(found, tx.luhn) if name == "card" else found
        label = lb.shared_label_or_spelled(F.lit(raw))
        return F.transform(found, lambda x, i: F.struct(F.lit(o).alias("rule"), i.alias("i"), x.alias("text"), label.alias("label"), F.lit(score).alias("score")))

    return F.concat(*(of(o, name, *rule) for o, (name, rule) in enumerate(vocab.RECOGNISERS.items())))


#: Kinds of rows of ``everything``.
RECOGNISED, PATTERN, ID, TOKEN = range(4)


def everything(chunks: DataFrame, built_in: bool = True) -> DataFrame:
    """(doc_id, chunk_index, kind, rule, i, text, label, score): matches of the built-in detectors, ids and suspicious tokens, in one pass."""
    c = F.col("chunk")
    kinds = {RECOGNISED: recogniser_spans(c), PATTERN: ruled(c, vocab.SUPPLEMENT)} if built_in else {}
    none = F.lit(None)
    token = F.transform(audit_tokens(c), lambda x, i: F.struct(F.lit(0).alias("rule"), i.alias("i"), x.alias("text"), none.cast("string").alias("label"), none.cast("double").alias("score")))
    kinds |= {ID: id_spans(c), TOKEN: token}

    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), *(x[f].alias(f) for f in ("rule", "i", "text", "label", "score"))))

    # A null text has none of any kind.
    return chunks.select(*CHUNK_KEY, F.explode(F.concat(*(of(*x) for x in kinds.items()))).alias("x")).select(*CHUNK_KEY, "x.*")


def language(chunk: Column) -> Column:
    """``ar`` where more than half of the letters are Arabic, ``en`` otherwise; blank and null texts too."""
    letters = F.regexp_count(chunk, F.lit(r"\p{L}"))
    arabic = F.regexp_count(chunk, F.lit(r"\p{IsArabic}"))
    return F.when(arabic * 2 > letters, F.lit("ar")).otherwise(F.lit("en"))


def routes(df: DataFrame, lang: Column) -> DataFrame:
    """Every row once for each detector of its language, with detector and detector_ord. Languages without a route go as en."""
    table = F.create_map(*(x for k, names in vocab.ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, names)))))
    found = F.coalesce(F.element_at(table, lang), F.array(*map(F.lit, vocab.ROUTES["en"])))
    return df.select("*", F.posexplode(found).alias("detector_ord", "detector"))


class Source(ABC):
    """What gives detections of chunks; ``name`` and ``ord`` say whose they are, and in which order."""

    name = "detector"
    ord = 0
    #: The setting with the least score of such a detector, as ``zero_shot_threshold``; without one every score counts.
    setting: str | None = None

    @abstractmethod
    def tried(self, chunks: DataFrame) -> DataFrame:
        """Detections of ``chunks(doc_id, chunk_index, chunk)``, and a row with an ``error`` only for each text that failed."""

    def apply(self, chunks: DataFrame, threshold: float = 0.0) -> DataFrame:
        """Detections of ``chunks(doc_id, chunk_index, chunk)`` scoring at least ``threshold``; texts that fail have none."""
        return self.tried(chunks).where(F.col("error").isNull() & (F.col("score") >= threshold)).select(*DETECTION)


class Detector(Source):
    """A source of detections that runs in Python. ``detect`` gets the texts of a batch and returns (text, label, score) triples for each."""

    #: Characters of a chunk that the model sees.
    most_chars: int | None = None

    @abstractmethod
    def detect(self, texts: list[str]) -> list[list[tuple[str, str, float]]]: ...

    def each(self, texts: list[str]) -> list[tuple[list | None, str | None]]:
        """The triples of each text and None, or None and why it failed. A batch that fails is tried text by text."""
        found, why = outcome(self.detect, texts)
        return [outcome(lambda t: self.detect([t])[0], t) for t in texts] if why else [(x, None) for x in found]

    def tried(self, chunks: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [(t or "")[: self.most_chars] for t in b.column(2).to_pylist()]
                found = self.each(texts)
                rows = [(i, p, *d, None) for i, (each, _) in enumerate(found) for p, d in enumerate(each or ())]
                rows += [(i, None, None, None, None, why) for i, (_, why) in enumerate(found) if why]
                at = pa.array([r[0] for r in rows], pa.int32())
                kinds = (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
                values = [pa.array([r[j + 1] for r in rows], k) for j, k in enumerate(kinds)]
                keys = [b.column(0).take(at), b.column(1).take(at)]
                yield pa.RecordBatch.from_arrays([*keys, *values], names=["doc_id", "chunk_index", "pos", "text", "label", "score", "error"])

        kind = chunks.schema["doc_id"].dataType.simpleString()
        found = chunks.select("doc_id", F.col("chunk_index").cast("int"), "chunk")
        found = found.mapInArrow(run, f"doc_id {kind}, chunk_index int, pos int, text string, label string, score double, error string")
        return found.withColumns({"detector": F.lit(self.name), "detector_ord": F.lit(self.ord), "score": F.coalesce("score", F.lit(0.8))})


class PatternDetector(Source):
    """The supplementary patterns, as a detector; no Python runs."""

    setting = "slm_threshold"

    def __init__(self, name: str = "qwen", ord: int = 0):
        self.name, self.ord = name, ord

    def tried(self, chunks: DataFrame) -> DataFrame:
        return self.apply(chunks).withColumn("error", F.lit(None).cast("string"))

    def apply(self, chunks: DataFrame, threshold: float = 0.0) -> DataFrame:
        return self.of(chunks.select(*CHUNK_KEY, F.explode(ruled(F.col("chunk"), vocab.SUPPLEMENT)).alias("x")), threshold)

    def of(self, found: DataFrame, threshold: float = 0.0) -> DataFrame:
        """Detections of the matches ``found(doc_id, chunk_index, x)``."""
        found = supplement_of(found).where(F.col("score") >= threshold)
        by_length = Window.partitionBy(*CHUNK_KEY).orderBy("rule", F.lower("text"))
        pos = (F.row_number().over(by_length) - 1).alias("pos")
        return found.select(*CHUNK_KEY, F.lit(self.name).alias("detector"), F.lit(self.ord).alias("detector_ord"), pos, "text", "label", "score")


class RecogniserDetector(PatternDetector):
    """The built-in recognisers, as a detector; no Python runs."""

    setting = "recogniser_threshold"

    def __init__(self, name: str = "presidio", ord: int = 0):
        super().__init__(name, ord)

    def apply(self, chunks: DataFrame, threshold: float = 0.35) -> DataFrame:
        return recognised(recognise_all(chunks), self.name, self.ord, threshold)


def recognised(found: DataFrame, name: str, ord: int, threshold: float) -> DataFrame:
    """``found(doc_id, chunk_index, text, label, score)`` as detections: those above the threshold, longest first, each once, without what
    recognisers are known to mistake."""
    from .ensemble import dedup_detections
    from .filters import recogniser_false_positives

    pos = (F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy(F.length("text").desc(), F.lower("text"), "label")) - 1).alias("pos")
    found = found.where(F.col("score") >= threshold)
    found = found.select(*CHUNK_KEY, F.lit(name).alias("detector"), F.lit(ord).alias("detector_ord"), pos, "text", "label", "score")
    return recogniser_false_positives(dedup_detections(found)).select(*DETECTION)
