"""Line deduplication: the earliest ranked occurrence of a line stays, all others go, and offsets are those of the original.

A text is cut into units: lines, and within lines sentences, as flowing text may hold a repeated passage anywhere in a line;
or paragraphs. Units are normalised (case, white space, edge punctuation) and hashed to 128 bits. A unit of few words says
little by itself, so it is hashed together with the units that follow it, or that stand before it at a text's end, up to
``min_words`` words. Besides, every whole line is hashed by itself, whatever its length and wherever it is cut, and goes with all its units if
it is not the earliest of its kind.

Each task first settles the digests that it sees more than once, so a digest leaves a task once, however hot it is; then one
shuffle by digest, sorted by rank, settles the rest as a stream. Only removed units travel back to their documents.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, table

MIN_WORDS = 8
#: Digests that a task holds before it passes them on.
HELD = 200_000
#: Added to the place of a line's first unit, where a whole line is meant.
WHOLE = 1 << 30
#: What ends a unit: a line's end, and for lines also a sentence's; and blank lines for paragraphs.
ENDS = {"line": re.compile(r"\n|(?<=[.!?])[^\S\n]+"), "paragraph": re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")}
EDGES = "\"'()[]{}.,;:!?*-_ "


def units_of(text: str, unit: str = "line") -> list[tuple[int, int]]:
    """(start, end) of the units with a word, in code points; what ends a unit is not in it."""
    found, start = [], 0
    for m in ENDS[unit].finditer(text):
        found.append((start, m.start()))
        start = m.end()
    found.append((start, len(text)))
    return [(a, b) for a, b in found if b > a and not text[a:b].isspace()]


def digests(text: str, spans: list[tuple[int, int]], min_words: int = MIN_WORDS) -> list[bytes | None]:
    """A 16-byte digest for each unit; None for all if the whole text has fewer words."""
    plain = [" ".join(text[a:b].lower().split()).strip(EDGES) for a, b in spans]
    counts = [p.count(" ") + 1 for p in plain]
    if sum(counts) < min_words:
        return [None] * len(spans)
    out: list[bytes | None] = []
    for i, p in enumerate(plain):
        n, a, b = counts[i], i, i + 1
        while n < min_words:
            if b < len(plain):
                n, b = n + counts[b], b + 1
            else:
                a -= 1
                n += counts[a]
        key = p if b - a == 1 else f"{i - a}\0" + "\0".join(plain[a:b])
        out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "replace")))
    return out


def lines_of(text: str, spans: list[tuple[int, int]], unit: str = "line") -> list[range]:
    """The units of each whole line, or of each paragraph."""
    if unit != "line":
        return [range(i, i + 1) for i in range(len(spans))]
    starts = [i for i, (a, _) in enumerate(spans) if not i or "\n" in text[spans[i - 1][1] : a]]
    return [range(a, b) for a, b in zip(starts, [*starts[1:], len(spans)])]


def line_digests(text: str, spans: list[tuple[int, int]], unit: str = "line") -> list[tuple[int, bytes]]:
    """(first unit, 16-byte digest) of the whole lines."""
    out = []
    for r in lines_of(text, spans, unit):
        whole = " ".join(text[spans[r.start][0] : spans[r.stop - 1][1]].lower().split())
        out.append((r.start, xxhash.xxh3_128_digest(("line\0" + (whole.strip(EDGES) or whole)).encode("utf-8", "replace"))))
    return out


def removed_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __hash, unit): the units of ``docs(rank, __id, __hash, text)`` that are not the earliest of their digest, and
    ``WHOLE`` more than the first unit of each line that is not.

    ``rank`` is a struct that orders documents; units of one document rank by their place.
    """
    kind = docs.schema["rank"].dataType.simpleString()
    names = ["rank", "__id", "__hash", "unit", "digest", "gone"]
    schema = f"rank {kind}, __id string, __hash long, unit int, digest binary, gone boolean"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[bytes, tuple] = {}
            rows: list[tuple] = []
            hashes = b.column(2).to_pylist()
            ranks = b.column(0).to_pylist()
            order = [tuple(r.values()) for r in ranks]

            def flush() -> pa.RecordBatch:
                # What is settled travels under a key of its own, not to where its digest is settled.
                rows[:] = [(i, u, b"%d/%d" % (hashes[i], u), True) for i, u in rows]
                rows.extend((i, u, d, False) for d, (_, u, i) in best.items())
                at = pa.array([r[0] for r in rows], pa.int32())
                columns = [c.take(at) for c in b.columns[:3]]
                columns += [pa.array(x, k) for x, k in zip(list(zip(*rows))[1:] or [()] * 3, (pa.int32(), pa.binary(), pa.bool_()))]
                best.clear(), rows.clear()
                return pa.RecordBatch.from_arrays(columns, names=names)

            for i, text in enumerate(b.column(3)):
                text = text.as_py() or ""
                spans = units_of(text, unit)
                whole = [(WHOLE + u, d) for u, d in line_digests(text, spans, unit)]
                for u, d in itertools.chain(enumerate(digests(text, spans, min_words)), whole):
                    if d is None:
                        continue
                    mine, other = (order[i], u, i), best.get(d)
                    if other is None:
                        best[d] = mine
                    elif other[:2] <= mine[:2]:
                        # A repeated row stands where its twin does and stays with it.
                        if other[:2] != mine[:2]:
                            rows.append((i, u))
                    else:
                        rows.append((other[2], other[1]))
                        best[d] = mine
                if len(best) + len(rows) >= HELD:
                    yield flush()
            yield flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for b in batches:
            keep = []
            for i, (r, u, d, gone) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 3, 4, 5)))):
                if d != last:
                    last, first = d, (r, u)
                if gone or (r, u) != first:
                    keep.append(i)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(j).take(at) for j in (1, 2, 3)], names=names[1:4])

    here = docs.select("rank", "__id", "__hash", "text").mapInArrow(local, schema)
    met = here.repartition("digest").sortWithinPartitions("digest", "rank", "unit")
    return met.mapInArrow(settle, "__id string, __hash long, unit int")


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_units, n_removed, removed (start, end in code points), kept_text.

    Rank is the order of ids, null last, then of text hashes, then the place in the text. Null and empty texts have no unit
    and an empty kept_text; of a text of fewer than ``min_words`` words only whole lines are compared. Rows alike in id and text are one
    document and get the same result each. ``kept_text`` is the original without the removed units and the white space that
    follows each. Other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.select("*", *row_key(src))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__hash").alias("hash"))
    gone = removed_units(src.select(rank.alias("rank"), "__id", "__hash", "text"), unit, min_words)
    gone = gone.groupBy("__id", "__hash").agg(F.sort_array(F.collect_set("unit")).alias("gone"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for text, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = text or ""
                spans = units_of(text, unit)
                if drop and drop[-1] >= WHOLE:
                    lines = {r.start: r for r in lines_of(text, spans, unit)}
                    drop = sorted({k for u in drop for k in (lines[u - WHOLE] if u >= WHOLE else (u,))})
                n.append(len(spans))
                removed.append([dict(zip(("start", "end"), spans[u])) for u in drop or ()])
                out, at = [], 0
                for u in drop or ():
                    a, e = spans[u]
                    out.append(text[at:a])
                    at = spans[u + 1][0] if u + 1 < len(spans) else len(text)
                kept.append("".join(out) + text[at:])
            m = pa.array([len(r) for r in removed], pa.int64())
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [b.column(0), pa.array(n, pa.int64()), m, pa.array(removed, spans_type), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_units", "n_removed", "removed", "kept_text"])

    rows = src.join(gone, ["__id", "__hash"], "left").select("doc_id", "text", "gone")
    schema = f"doc_id {kind}, n_units long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    return rows.mapInArrow(cut, schema)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_units, n_removed, removed spans, kept_chars and kept_sha256."""
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_units",
        "n_removed",
        "removed",
        F.length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )
