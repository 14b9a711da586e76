"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared exactly: the 64 bits are cut into ``radius + 2`` blocks, and two fingerprints within the radius
agree on at least two whole blocks, so one table for each pair of blocks brings every such pair together in some bucket.
In a bucket the fingerprints lie as vertical bit planes. The distances of one fingerprint to 64 others are counted at once
with carry-save counters, and a block of 64 is dropped as soon as all its distances exceed the radius. A bucket gives a
spanning forest of its links, not all pairs. Large buckets are cut into pieces, and each pair of pieces is its own unit of
work. Copies meet as one fingerprint before anything is compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, joined_once, row_key, shipped, whole_rows, written

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of a bucket's piece, and counters at work at once.
PIECE = 4096
ENTRIES = 1 << 18
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16
#: Words of the wide fingerprints of sets, and the bits within which two sets of Jaccard similarity 0.8 lie: their cosine is
#: 0.89, so about 19.4 of 128 bits differ, with a deviation of 4. Sets of so few shingles are not held against that.
WORDS, WIDE, FEW = 2, 40, 16
#: Bands of so many least hashes each: sets of similarity 0.8 share no band in 3 of a million cases.
BANDS, LEAST_HASHES = 32, 5
#: Of all least hashes so many are equal, or more, for sets of similarity 0.8: 128 on average, with a deviation of 5.
EQUAL = 103
#: Rows of a piece of a band whose sets are compared in pairs.
SETS = 1024
#: Pairs held at once.
PAIRS = 1 << 21


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 for a text without a word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), 0
    while chunk := [digest(x, seed) for x in itertools.islice(parts, SHINGLES)]:
        h = np.array(chunk, np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(chunk)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, fp long")


def planes_of(fp: np.ndarray) -> list[np.ndarray]:
    """Bit planes of rows of words: plane k holds bit k of 64 consecutive fingerprints in each word."""
    n = -(-len(fp) // BITS) * BITS
    padded = np.zeros((n, fp.shape[1]), np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return list(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64))


def close_pairs(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), lo[i] <= j < hi[i], whose fingerprints, of one word or a row of words, differ in at most ``radius`` bits."""
    fp = fp.reshape(len(fp), -1)
    planes, width = planes_of(fp), max(1, radius.bit_length())
    ahead = (1 << width) - 1 - radius  # so that the counters run over beyond the radius
    rows = np.flatnonzero(hi > lo)
    first, last = lo[rows] >> 6, (hi[rows] - 1) >> 6
    counts = last - first + 1
    ends = np.cumsum(counts)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, int(ends[-1]) if len(ends) else 0, ENTRIES):
        at = np.arange(a, min(a + ENTRIES, int(ends[-1])))
        r = np.searchsorted(ends, at, side="right")
        q, w = rows[r], first[r] + at - (ends[r] - counts[r])
        base = w << 6
        below, above = np.clip(lo[q] - base, 0, 64), np.clip(hi[q] - base, 0, 64)
        over = ~(low_bits(above) & ~low_bits(below))  # what is outside the range counts as too far
        counter = [np.full(len(q), FULL if ahead >> i & 1 else 0, np.uint64) for i in range(width)]
        for k, plane in enumerate(planes):
            carry = plane[w] ^ (-((fp[q, k // BITS] >> np.uint64(k % BITS)) & np.uint64(1)).astype(np.int64)).view(np.uint64)
            for c in counter:
                full = c & carry
                c ^= carry
                carry = full
            over |= carry
            if k % 4 == 3:
                alive = over != FULL
                if (kept := int(alive.sum())) * 4 < len(q) * 3:
                    q, w, over, counter = q[alive], w[alive], over[alive], [c[alive] for c in counter]
                if not kept:
                    break
        if len(q) and (hit := np.flatnonzero(over != FULL)).size:
            near = np.unpackbits((~over[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, bit = np.nonzero(near)
            left.append(q[hit[e]])
            right.append((w[hit[e]] << 6) + bit)
    return np.concatenate(left), np.concatenate(right)


def low_bits(n: np.ndarray) -> np.ndarray:
    """Words whose n lowest bits are set, n from 0 to 64."""
    n = n.astype(np.uint64)
    return np.where(n >= 64, FULL, (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b connect it with."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if not (differ := x != y).any():
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(label, up := label[label]):
            label = up


def unit_links(unit: np.ndarray, piece: np.ndarray, mixed: np.ndarray, fp: np.ndarray, radius: int):
    """Spanning links of consecutive rows, sorted by unit and piece; a mixed unit links only across its two pieces."""
    n = len(fp)
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    end = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
    lo = np.arange(1, n + 1)
    part = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (piece[1:] != piece[:-1])])
    part_end = np.repeat(np.r_[part[1:], n], np.diff(np.r_[part, n]))
    lo = np.where(mixed, part_end, lo)
    a, b = close_pairs(fp, lo, end, radius)
    label = forest(n, a, b)
    member = np.flatnonzero(label != np.arange(n))
    return fp[label[member]], fp[member]


def links(distinct: DataFrame, radius: int = 3, piece: int = PIECE) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints ``distinct(fp)`` that are within the radius, directly or by others.

    A bucket of K different fingerprints that agree on two blocks travels K / ``piece`` times, as each two pieces meet in a task of
    their own: work is its square, over ever more tasks. Blocks are 12 or 13 bits, so that takes fingerprints that crowd.
    """
    blocks = radius + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]

    def block(i: int):
        return F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))

    keys = [
        F.struct(F.lit(t).alias("t"), F.shiftleft(block(i), 32).bitwiseOR(block(j)).alias("key"))
        for t, (i, j) in enumerate(itertools.combinations(range(blocks), 2))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    # Buckets of more than one piece are few; this join only finds them.
    hot = rows.groupBy("t", "key").count().where(F.col("count") > piece)
    n = F.coalesce(F.ceil(F.col("count") / piece).cast("int"), F.lit(1))
    rows = rows.join(hot, ["t", "key"], "left").withColumn("n", n).withColumn("p", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    rows = rows.select("t", "key", "fp", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    rows = rows.select("t", "key", F.least("p", "other").alias("a"), F.greatest("p", "other").alias("b"), "p", "fp")
    unit = ["t", "key", "a", "b"]
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "p", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]))
                if sum(x.shape[1] for x in held) < ENTRIES // 8:
                    continue
            if not held:
                continue
            m = np.concatenate(held, axis=1)
            new = np.r_[True, (m[:4, 1:] != m[:4, :-1]).any(axis=0)]
            cut = m.shape[1] if b is None else int(np.flatnonzero(new)[-1])  # the last unit may go on
            held = [m[:, cut:]]
            if cut:
                u, v = unit_links(np.cumsum(new)[:cut], m[4, :cut], (m[2] != m[3])[:cut], m[5, :cut].view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (signed long) and component_id, the smallest doc_id reachable.

    A null or empty text has the fingerprint zero, which links like any other. A row whose id is null keeps it and takes
    part in the links; a component of null ids only has the component_id null. Repeated rows and ids give a row each.
    Other columns of ``docs`` are not read. Of no rows come no rows.
    """
    fps = checkpoint(fingerprints(docs, id_col, text_col, words))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    roots = components(links(nodes.select("fp"), radius))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root"))
    nodes = checkpoint(nodes)
    low = nodes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = joined_once(nodes, low, "root").select("fp", "component_id", F.col("copies").alias("n"))
    return joined_once(fps, named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, parts: list, keep: DataFrame) -> DataFrame:
    """A row of ``docs`` for each of ``keep(__id, __hash)``; rows alike in both fall together before they travel."""
    names = ["__id", "__hash"]
    return docs.select(whole_rows(docs), *parts).dropDuplicates(names).join(keep, names).select("__row.*")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that of the smallest id, then of the smallest text hash.

    Ids may be null (these come last) and may repeat; of rows alike in id and text one stays. Null and empty texts are alike.
    Columns may have any name. Of no rows come no rows.
    """
    parts = row_key(docs, id_col, text_col)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *parts)
    found = near_duplicates(docs.select(key.alias("key"), text_col), "key", text_col, words, radius)
    keep = found.where("doc_id <=> component_id").select("doc_id.__id", "doc_id.__hash").distinct()
    return one_of_each(docs, parts, keep)


def shingle_set(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles: of a short text the one of all its words, without a word only zero."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(1, np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.array([xxhash.xxh64_intdigest(x, seed) for x in parts], np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, each made another that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = mixed(np.arange(1, BANDS * LEAST_HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, each counted once, in ``WORDS`` words."""
    out = np.zeros(WORDS, np.uint64)
    for w in range(WORDS):
        total = np.zeros(BITS, np.int64)
        for a in range(0, len(hashes), SHINGLES):
            part = hashes[a : a + SHINGLES]
            part = mixed(part + np.uint64(w)) if w else part
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of a set's hashes by each of many orders."""
    least = np.full(len(FACTORS), FULL)
    for a in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[None, a : a + 512] * FACTORS[:, None]).min(axis=1))
    return mixed(least)


def bands_of(least: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes."""
    rows = least.reshape(BANDS, LEAST_HASHES) * FACTORS[None, :LEAST_HASHES]
    return mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


SIDE = ["part", *(f"f{w}" for w in range(WORDS)), "n"]


def marks(src: DataFrame, words: int) -> DataFrame:
    """(key, name, f0, ..., n, bands) of ``src(key, text)``; texts of one set of shingles have one ``name``, of 128 bits."""
    kind = src.schema["key"].dataType.simpleString()
    names = ["key", "name", *SIDE[1:], "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, fps, n, bands = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                fps.append(set_fingerprint(s))
                n.append(len(s))
                bands.append(bands_of(least_hashes(s)))
            fps = np.array(fps, np.uint64).reshape(-1, WORDS).view(np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *bands]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(flat))
            columns = [pa.array(same, pa.binary()), *(pa.array(np.ascontiguousarray(f)) for f in fps.T), pa.array(n, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    schema = f"key {kind}, name binary, {', '.join(f'f{w} long' for w in range(WORDS))}, n long, bands array<bigint>"
    return src.select("key", "text").mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Columns of longs as arrays that end where one of the first ``keys``, which are sorted, changes."""
    held: list[np.ndarray] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
            if sum(x.shape[1] for x in held) < ENTRIES // 8:
                continue
        if not held:
            continue
        m = np.concatenate(held, axis=1)
        new = np.flatnonzero((m[:keys, 1:] != m[:keys, :-1]).any(axis=0)) + 1
        cut = m.shape[1] if b is None else int(new[-1]) if len(new) else 0  # the last group may go on
        held = [m[:, cut:]]
        if cut:
            yield m[:, :cut]


def group_starts(m: np.ndarray, keys: int) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (m[:keys, 1:] != m[:keys, :-1]).any(axis=0)])


def met(nodes: DataFrame) -> DataFrame:
    """(s, same): the bands that more than one of ``nodes(same, bands)`` has, streamed band by band."""
    rows = nodes.select(F.explode("bands").alias("s"), "same").repartition("s").sortWithinPartitions("s", "same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            m = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            m = m if held is None else np.concatenate([held, m], axis=1)
            if m.shape[1] < 3:
                held = m
                continue
            # The last row waits for the next batch, and the one before it comes along to be known by.
            equal = m[0, 1:] == m[0, :-1]
            keep = np.r_[equal, False] | np.r_[False, equal]
            keep[0] &= held is None or not settled
            keep[-1] = False
            settled, held = True, m[:, -2:]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in m[:, keep]], names=["s", "same"])
        if held is not None:
            keep = np.r_[held[0, 1:] == held[0, :-1], held[0, 1:] == held[0, :-1]] if held.shape[1] == 2 else np.zeros(1, bool)
            keep[0] &= not settled
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[:, keep]], names=["s", "same"])

    return rows.mapInArrow(run, "s long, same long")


def may_be_alike(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which columns (part, f0, ..., n) of two arrays are of two parts and not too different in size and fingerprint."""
    n, m = left[-1], right[-1]
    bits = np.bitwise_count((left[1:-1] ^ right[1:-1]).view(np.uint64)).sum(axis=0)
    near = (bits <= WIDE) | (np.minimum(n, m) <= FEW)
    return (left[0] != right[0]) & near & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)


def stars(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v, k, d): of each piece of k rows of a band in ``rows(s, p, same, part, ...)`` the middle one, and each other that may
    be alike, d bits away.

    The middle is the row whose fingerprint is nearest to the bits that most of the piece have: what near-copies are copies of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in whole_groups(batches, 2):
            start = group_starts(m, 2)
            sizes = np.diff(np.r_[start, m.shape[1]])
            group, fp = np.repeat(np.arange(len(start)), sizes), np.ascontiguousarray(m[4:-1].T)
            bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
            most = 2 * np.add.reduceat(bits, start, axis=0, dtype=np.int64) > sizes[:, None]
            most = np.packbits(most, axis=1, bitorder="little").view(np.int64)
            away = np.bitwise_count((fp ^ most[group]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            middle = np.repeat(np.lexsort((m[2], away, group))[start], sizes)
            ok = may_be_alike(m[3:, middle], m[3:], similarity)
            d = np.bitwise_count((fp ^ fp[middle]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            columns = (m[2, middle][ok], m[2][ok], np.repeat(sizes, sizes)[ok], d[ok])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["u", "v", "k", "d"])

    rows = rows.select("s", "p", "same", *SIDE).repartition("s", "p").sortWithinPartitions("s", "p", "same")
    return rows.mapInArrow(run, "u long, v long, k long, d long")


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(same, sketch, hashes) of ``texts(same, text)``: four bytes of each band and one of each least hash; and the sorted hashes
    of the set, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(1)]
            least = [least_hashes(s) for s in sets]
            made = [bands_of(x).astype(np.uint32).tobytes() + x.astype(np.uint8).tobytes() for x in least]
            short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), pa.array(short, pa.binary())], names=["same", "sketch", "hashes"])

    return texts.select("same", "text").mapInArrow(run, "same long, sketch binary, hashes binary")


def whole_tables(batches: Iterator[pa.RecordBatch], keys: int, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows joined to batches of about ``most`` bytes that end where one of the first ``keys`` columns, which are sorted, changes."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(b)
            if sum(x.nbytes for x in held) < most:
                continue
        if not held:
            continue
        t = pa.concat_batches(held)
        m = np.stack([t.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        new = np.flatnonzero((m[:, 1:] != m[:, :-1]).any(axis=0)) + 1
        cut = len(t) if b is None else int(new[-1]) if len(new) else 0  # the last group may go on
        held = [t.slice(cut)]
        if cut:
            yield t.slice(0, cut)


def candidates(m: np.ndarray, sketch: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one unit that may be alike, columns of m: s, a, b, p, same, part, ..., n; sorted by part.

    A pair that meets in several bands is one of the first of them. What the fingerprints, and then the least hashes, show to be
    too far apart is none.
    """
    size = m.shape[1]
    own = np.flatnonzero(np.r_[True, m[5, 1:] != m[5, :-1]])
    lo, hi = np.repeat(np.r_[own[1:], size], np.diff(np.r_[own, size])), np.full(size, size)
    if size <= BITS:
        i = np.repeat(np.arange(size), hi - lo)
        j = np.concatenate([np.arange(a, size) for a in lo.tolist()])
        todo = iter([(i, j)])
    else:
        fp, few, step = np.ascontiguousarray(m[6:-1].T).view(np.uint64), m[-1] <= FEW, max(1, PAIRS // size)

        def blocks():
            for a in range(0, size, step):
                here = (np.arange(size) >= a) & (np.arange(size) < a + step)
                yield close_pairs(fp, lo, np.where(here & ~few, hi, lo), WIDE)
                # Pairs with a set of few shingles are held against its size only.
                for k in np.flatnonzero(here & few).tolist():
                    yield np.full(size - lo[k], k), np.arange(lo[k], size)

        todo = blocks()
    band, least = sketch[:, : 4 * BANDS].copy().view(np.uint32), sketch[:, 4 * BANDS :]
    for i, j in todo:
        ok = may_be_alike(m[5:, i], m[5:, j], similarity) & ((m[1, i] == m[2, i]) | (m[3, i] != m[3, j]))
        i, j = i[ok], j[ok]
        for a in range(0, len(i), SHINGLES):
            x, y = i[a : a + SHINGLES], j[a : a + SHINGLES]
            ok = band[x, (band[x] == band[y]).argmax(axis=1)] == m[0, x].astype(np.uint32)
            ok &= ((least[x] == least[y]).sum(axis=1) >= EQUAL) | (np.minimum(m[-1, x], m[-1, y]) <= FEW)
            yield x[ok], y[ok]


def in_units(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, int]]:
    """Rows of whole units (s, a, b) of several: all rows at hand, their first n columns and sketches, and where the unit lies."""
    for t in whole_tables(batches, 3):
        m = np.stack([t.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n)])
        sketch = np.frombuffer(b"".join(x.as_py() for x in t.column(n)), np.uint8).reshape(len(t), -1)
        start = group_starts(m, 3).tolist()
        for a, z in zip(start, [*start[1:], len(t)]):
            if z - a > 1:
                yield t, m[:, a:z], sketch[a:z], a, z


def apart(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs of ``rows(s, same, part, ...)`` that meet in a band, are of two parts, and are alike but for a few hashes.

    Each band, or each two pieces of a large one, is a unit. First only sketches travel there, and single out the sets that may
    be like another; then these sets do, and only links leave.
    """
    rows = rows.select("s", "same", *SIDE).join(sets.select("same", "sketch"), "same")
    n = F.ceil(F.col("n_rows") / SETS).cast("int")
    large = rows.groupBy("s").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > SETS)
    rows = rows.join(large, "s", "left").withColumn("pieces", F.coalesce(n, F.lit(1)))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("same"), "pieces").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    numbers, unit = ["s", "a", "b", "p", "same", *SIDE], ["s", "a", "b"]
    rows = rows.withColumns({"a": F.least("p", "other"), "b": F.greatest("p", "other")}).select(*numbers, "sketch")
    schema = ", ".join(f"{c} {'int' if c in 'abp' else 'long'}" for c in numbers) + ", sketch binary"

    def single_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, m, sketch, a, z in in_units(batches, len(numbers)):
            near = np.zeros(z - a, bool)
            for x, y in candidates(m, sketch, similarity):
                near[x] = near[y] = True
            if near.any():
                yield t.slice(a, z - a).filter(pa.array(near))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, m, sketch, a, z in in_units(batches, len(numbers)):
            hashes, found = [x.as_buffer() for x in t.column(len(numbers) + 1).slice(a, z - a)], []
            for x, y in candidates(m, sketch, similarity):
                for p, q in zip(x.tolist(), y.tolist()):
                    both = len(np.intersect1d(np.frombuffer(hashes[p], np.uint32), np.frombuffer(hashes[q], np.uint32), assume_unique=True))
                    total = m[-1, p] + m[-1, q]
                    # Different shingles of one set may have one short hash.
                    if both >= similarity / (1 + similarity) * total - 2 - total**2 / 2**32:
                        found.append((int(m[4, p]), int(m[4, q])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "part", "same").mapInArrow(single_out, schema)
    rows = rows.join(sets.select("same", "hashes"), "same").select(*numbers, "sketch", "hashes")
    rows = rows.repartition(*unit).sortWithinPartitions(*unit, "part", "same")
    return rows.mapInArrow(compare, "u long, v long")


def alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose shingle sets in ``texts(same, text)`` have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in batches:
            keep = []
            for i, (u, a, c) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3))):
                if u != last:
                    last, left = u, shingle_set(a.as_py(), words)
                right = shingle_set(c.as_py(), words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both >= similarity * (len(left) + len(right) - both) - 1e-9:
                    keep.append(i)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["u", "v"])

    for at in ("v", "u"):
        pairs = pairs.join(texts.select(F.col("same").alias(at), F.col("text").alias(f"text_{at}")), at)
    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def kept_of_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One row of each group of ``docs`` that pairs of at least this Jaccard similarity of word shingles connect.

    The row is that of the smallest id, null last, then of the smallest text hash, with all its columns. Sets meet in a band of
    least hashes, must be within ``WIDE`` bits of a SimHash of ``WORDS`` words, and are then compared exactly, shingle by shingle. First
    each set is compared with the middle of its largest band, then with the middles of all of them that are not yet in its
    group; last come, by bit planes, the pairs that meet in a band and are still in different groups. These are compared where
    the band's sets lie, each pair once, and only links leave that place, to be compared exactly. So no more rows travel than sets
    have bands, times the pieces of a large band, as each pair of pieces is a unit of its own. A null text is an empty one; texts without a word are
    alike. Texts of any length count with all their shingles. Columns may have any name. Of no rows come no rows.
    """
    parts = row_key(docs, id_col, text_col)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *parts)
    src = docs.select(*parts, key.alias("key"), F.col(text_col).cast("string").alias("text"))
    firsts = [F.first(c).alias(c) for c in (*SIDE[1:], "bands")]
    nodes = marks(src, words).groupBy("name").agg(F.min("key").alias("key"), *firsts).drop("name")
    nodes = checkpoint(nodes.withColumn("same", F.monotonically_increasing_id()))  # from now on a set's number
    rows = met(nodes).join(nodes.select("same", *SIDE[1:]), "same")
    large = rows.groupBy("s").count().where(F.col("count") > PIECE)
    pieces = F.coalesce(F.ceil(F.col("count") / PIECE).cast("int"), F.lit(1))
    rows = rows.join(large, "s", "left").withColumn("pieces", pieces).drop("count")
    rows = checkpoint(rows.withColumn("p", F.pmod(F.xxhash64("same"), "pieces").cast("int")))

    # The documents travel once, by sorting whatever the size, to the sets that meet another; later joins move only the texts of these.
    first = nodes.join(rows.select("same").distinct(), "same").select("same", "key.__id", "key.__hash")
    once = src.select("__id", "__hash", "text").dropDuplicates(["__id", "__hash"])
    texts = written(once.join(written(first, "alike").hint("merge"), ["__id", "__hash"]).select("same", "text"), "alike")

    def alike_of(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        return checkpoint(alike(pairs, texts, words, similarity))

    def grouped(found: DataFrame | None) -> DataFrame:
        if found is None:
            return rows.withColumn("part", F.col("same"))
        roots = written(components(found).select(F.col("node").alias("same"), F.col("root").alias("part")), "alike")
        return rows.join(roots, "same", "left").withColumn("part", F.coalesce("part", "same"))

    nearest = stars(grouped(None), similarity).groupBy("v").agg(F.min_by("u", F.struct(-F.col("k"), "d", "u")).alias("u"))
    found = alike_of(nearest)
    found = found.union(alike_of(stars(grouped(found), similarity)))
    labelled = grouped(found)
    several = labelled.groupBy("s").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    labelled = checkpoint(labelled.join(written(several.where("low != high").select("s"), "alike"), "s", "left_semi"))
    open_sets = written(labelled.select("same").distinct(), "alike")
    sets = written(sketches(texts.join(open_sets, "same", "left_semi"), words), "alike")
    found = found.union(alike_of(apart(labelled, sets, similarity)))
    roots = components(found).select(F.col("node").alias("same"), "root")
    keep = nodes.join(roots, "same", "left").groupBy(F.coalesce("root", "same").alias("root")).agg(F.min("key").alias("key"))
    return one_of_each(docs, parts, keep.select("key.__id", "key.__hash").distinct())


def op9_simhash_bit_sliced(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
