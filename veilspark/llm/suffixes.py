"""Removal of long repeated byte strings by blockwise suffix sorting with a difference cover.

Every stretch of ``length`` bytes that starts at two places is to be found. Which suffixes must be sorted together is settled
first: a window of that length is put into the bucket of its minimiser, the k-gram of least rank in it (leftmost among
equals). Equal windows have equal minimisers, so all copies of a window meet in one bucket, and a bucket whose k-gram occurs
once needs no sorting at all. Only buckets that repeat receive their windows' text.

Ranks are hashes, but k-grams that a first pass finds to be frequent come last, so that a common line or phrase is no bucket if
there is anything else in the window. A bucket that is large nevertheless is split by content, not gathered: its windows are
parted by where the k-gram stands in them, ``PART`` places together, and by the bytes that all windows of such a part share.
Equal windows agree in both. What is too large even so is split again, to single windows. All buckets and parts are then
sorted alike, in blocks of bounded size.

In a block's text the suffixes at the positions of a difference cover modulo 31 are ranked first, by prefix doubling. Windows
are sorted by their first 31 bytes, and ties are resolved by the ranks at the one offset, less than 31, at which both windows
meet the cover; so no comparison is longer however long the repeats are. Neighbours in that order are equal in their first
``length`` bytes or have no equal. Texts that are copies as wholes are one text with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shipped, table

LENGTH = 200
GRAM = 32
#: Bytes of text that are hashed at once, and bytes of buckets sorted at once.
CHUNK, SORTED_BYTES = 1 << 18, 1 << 20
#: Occurrences of a bucket, and bytes of different texts in one, beyond which it is split by content.
MOST, BLOCK = 4096, 2 << 20
#: Places of the k-gram in a window that go together when a bucket is split.
PART = 32
#: A k-gram is frequent from this share of those counted on, and from so many places on; at most 2 / SHARE are. Only speed depends on it.
SHARE, LEAST = 1e-5, 1024
#: k-grams that a task counts at once, and rows or bytes that it passes on at once.
COUNTED, ROWS_OUT, BYTES_OUT = 1 << 18, 1 << 15, 1 << 24
PLACE_BITS = 20
#: A difference cover modulo 31: every residue is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
U8, U64 = np.uint8, np.uint64
#: Hashes under LOW are few, but hardly a window of text has none; frequent and other hashes rank behind them, by the top bit.
LOW, TOP = U64(1 << 61), U64(1 << 63)
NONE = np.zeros(0, U64)


def _offsets() -> np.ndarray:
    """For residues a and b the least offset that takes both into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[next(d for d in range(PERIOD) if inside[a + d] and inside[b + d]) for b in range(PERIOD)] for a in range(PERIOD)])


MEET = _offsets()


def gram_hashes(t: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of the k-gram at every position; gram is a power of two."""
    h, width = t.astype(U64) + U64(0x9E3779B97F4A7C15), 1
    for i in range(gram.bit_length() - 1):
        h = h[:-width] * U64(0xD6E8FEB86659FD93 + 2 * i * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF) + h[width:]
        width *= 2
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def ranks(h: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Ranks of hashed k-grams: low ones that are not frequent, then all others; without low bits, so that a place fits in."""
    late = h >= LOW
    low = np.flatnonzero(~late)
    late[low[member(h[low], often)]] = True
    return ((h >> U64(1)) | np.where(late, TOP, U64(0))) & ~U64((1 << PLACE_BITS) - 1)


def minimisers(t: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, often: np.ndarray = NONE, h=None):
    """Runs of windows with one minimiser, in texts that end at ``ends`` of t: (hash, its place, first window, last window)."""
    n = len(t) - length + 1
    if n <= 0:
        return (np.empty(0, U64), *(np.empty(0, np.int64) for _ in range(3)))
    h = gram_hashes(t, gram) if h is None else h
    low = sliding_min(ranks(h, often) | np.arange(len(h), dtype=U64), length - gram + 1)[:n]
    at = (low & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(n, bool)
    for a, e in zip(starts.tolist(), ends.tolist()):
        if e - a >= length:
            valid[a : e - length + 1] = True
    begin = np.flatnonzero(valid & np.concatenate([[True], (at[1:] != at[:-1]) | ~valid[:-1]]))
    stop = np.flatnonzero(valid & np.concatenate([(at[1:] != at[:-1]) | ~valid[1:], [True]]))
    return h[at[begin]], at[begin], begin, stop


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as a number that compares as they do."""
    w, width = t.astype(U64), 1
    for _ in range(3):
        w = (w[:-width] << U64(8 * width)) | w[width:]
        width *= 2
    return w


def dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 0, given an order by the keys: equal keys, equal ranks."""
    new = np.zeros(len(order), np.int64)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(t: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """For every position of the cover the rank of its suffix by at least ``depth`` bytes; 0 elsewhere."""
    n = len(w) - PERIOD
    sample = [np.arange(r, n, PERIOD) for r in COVER]
    at, lengths = np.concatenate(sample), [len(s) for s in sample]
    keys = [w[at], w[at + 8], w[at + 16], w[at + 23]]
    rank = dense(np.lexsort(keys[::-1]), keys)
    known, step = PERIOD, 1
    last = np.repeat(np.cumsum(lengths), lengths)  # where a residue's positions end
    while known < depth:
        nxt = np.arange(len(at)) + step
        pair = rank * (len(at) + 1) + np.where(nxt < last, rank[np.minimum(nxt, len(at) - 1)] + 1, 0)
        rank = dense(np.argsort(pair, kind="stable"), [pair])
        known, step = 2 * known, 2 * step
    out = np.zeros(len(t), np.int64)
    out[at] = rank
    return out


def repeated(t: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows that begin at ``starts`` of t have an equal among them. All lie inside t."""
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    t = np.concatenate([t, np.zeros(length + 4 * PERIOD, U8)])
    w = words_at(t)
    keys = [w[starts], w[starts + 8], w[starts + 16], w[starts + 23]]
    order = np.lexsort(keys[::-1])
    tie = dense(order, keys)[order]
    counts = np.bincount(tie)
    order = order[counts[tie] > 1]
    if not len(order):
        return np.zeros(len(starts), bool)
    tie = tie[counts[tie] > 1]
    s = starts[order]
    rank = cover_ranks(t, w, length)
    # Quicksort of all ties at once: in each round every group is parted by its middle element.
    group, open_at = tie.copy(), np.arange(len(s))
    while len(open_at):
        g = group[open_at]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(g)]]))
        mine = s[open_at]
        pivot = np.repeat(mine[first + sizes // 2], sizes)
        d = MEET[mine % PERIOD, pivot % PERIOD]
        side = np.sign(rank[mine + d] - rank[pivot + d])
        moved = np.lexsort((side, np.repeat(np.arange(len(first)), sizes)))
        s[open_at], order[open_at] = mine[moved], order[open_at][moved]
        side = side[moved]
        part = np.cumsum(np.concatenate([[True], (np.repeat(np.arange(len(first)), sizes)[1:] != np.repeat(np.arange(len(first)), sizes)[:-1]) | (side[1:] != side[:-1])]))
        group[open_at] = part
        many = np.bincount(part)[part] > 1
        open_at = open_at[many & (side != 0)]
    same = tie[1:] == tie[:-1]
    pairs = np.flatnonzero(same)
    for k in [*range(32, length - 7, 8), length - 8]:  # what the first words have not compared
        a, b = s[pairs] + k, s[pairs + 1] + k
        pairs = pairs[w[a] == w[b]]
    a, b = s[pairs] + 24, s[pairs + 1] + 24
    pairs = pairs[w[a] == w[b]]
    out = np.zeros(len(starts), bool)
    out[order[pairs]] = True
    out[order[pairs + 1]] = True
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs that are set."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def slices(texts: list[pa.Buffer], length: int) -> Iterator[tuple[int, list[np.ndarray], int]]:
    """(number of the first, arrays, place): whole texts up to a chunk, or a slice of one that is longer, where it stands.

    Every window lies whole in just one of them.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        whole = [np.frombuffer(x, U8) if len(x) else np.empty(0, U8) for x in texts[i:j]]
        if size <= CHUNK:
            yield i, whole, 0
        else:
            for a in range(0, max(1, size - length + 1), CHUNK - length + 1):
                yield i, [whole[0][a : a + CHUNK]], a
        i = j


def counted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(gram, n): the frequent ones of a task's low k-grams and minimisers, and under null how many there were.

    Copies of a text count once a task.
    """
    values, counts, held, total = NONE, np.zeros(0, np.int64), [], 0
    seen: set[bytes] = set()

    def merge() -> None:
        nonlocal values, counts, held
        every, which = np.unique(np.concatenate([values, *held]), return_inverse=True)
        n = sum(map(len, held))
        values, counts, held = every, np.bincount(which, np.concatenate([counts, np.ones(n)]), len(every)).astype(np.int64), []
        if len(values) > COUNTED:
            top = np.sort(np.argpartition(counts, -COUNTED // 2)[-COUNTED // 2 :])
            values, counts = values[top], counts[top]

    for b in batches:
        texts = []
        for x in b.column(0):
            key = xxhash.xxh3_128_digest(memoryview(x.as_buffer()))
            if key not in seen:
                texts.append(x.as_buffer())
                seen.add(key)
        if len(seen) > 1 << 20:
            seen.clear()
        for _, some, _ in slices(texts, length):
            t = np.concatenate(some)
            if len(t) < length:
                continue
            h = gram_hashes(t)
            least = minimisers(t, np.cumsum([len(x) for x in some]), length, h=h)[0]
            held.append(np.concatenate([h[h < LOW], least[least >= LOW]]))
            total += len(held[-1])
            if sum(map(len, held)) > 4 * COUNTED:
                merge()
    merge()
    often = counts >= max(2, total * SHARE / 2)
    grams = pa.concat_arrays([pa.array([None], pa.int64()), pa.array(values[often].view(np.int64))])
    yield pa.RecordBatch.from_arrays([grams, pa.array(np.concatenate([[total], counts[often]]))], names=["gram", "n"])


def frequent_grams(texts: DataFrame, length: int, least: int) -> np.ndarray:
    """Sorted hashes of the frequent k-grams of ``texts(b)``, at most 2 / ``SHARE``."""
    found = texts.mapInArrow(lambda it: counted(it, length), "gram long, n long")
    found = checkpoint(found.groupBy("gram").agg(F.sum("n").alias("n")))
    total = found.where("gram IS NULL").first()
    if total is None:
        return NONE
    often = found.where(F.col("gram").isNotNull() & (F.col("n") >= max(least, total.n * SHARE / 2)))
    return np.sort(np.array([r.gram for r in often.select("gram").collect()], np.int64).view(U64))


def occurrences(batches: Iterator[pa.RecordBatch], length: int, often) -> Iterator[pa.RecordBatch]:
    """(bucket, k, run, gram): every run of windows with one minimiser; run packs first window << 16 | windows - 1.

    Runs of a frequent k-gram have it as gram, and a bucket of their own, not to be dealt to one place; such runs are joined
    where one begins behind the other, as in a periodic text.
    """
    for b in batches:
        keys = b.column(0)
        own = np.array([int.from_bytes(k.as_py()[:8], "little") for k in keys], U64)
        for i, some, base in slices([x.as_buffer() for x in b.column(1)], length):
            ends = np.cumsum([len(x) for x in some])
            h, _, first, last = minimisers(np.concatenate(some), ends, length, often=often())
            hot = member(h, often())
            owner = np.searchsorted(ends, first, side="right")
            place = first - np.concatenate([[0], ends[:-1]])[owner] + base
            # Within 32,768 places, so that the number of windows fits its bits.
            joins = np.zeros(len(h), bool)
            joins[1:] = hot[1:] & (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + (last - first)[:-1] + 1) & (place[1:] >> 15 == place[:-1] >> 15)
            head = np.flatnonzero(~joins)
            tail = np.append(head[1:] - 1, len(h) - 1)[: len(head)]
            h, hot, owner, place, n = h[head], hot[head], owner[head] + i, place[head], place[tail] + (last - first)[tail] - place[head]
            bucket = np.where(hot, own[owner] * U64(0x9E3779B97F4A7C15) + place.astype(U64), h).view(np.int64)
            columns = [pa.array(bucket), keys.take(pa.array(owner)), pa.array((place << 16) | n), pa.array(h.view(np.int64), mask=~hot)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "k", "run", "gram"])


def repeating(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket those of a gram and those whose bucket has several; if more than ``most``, with it as gram.

    At most ``most`` rows of a bucket are held.
    """
    held: list[pa.RecordBatch] = []
    n, last, large = 0, None, False

    def give(rows: list[pa.RecordBatch], is_large: bool) -> Iterator[pa.RecordBatch]:
        for r in rows:
            yield pa.RecordBatch.from_arrays([*r.columns[:3], r.column(0) if is_large else r.column(3)], names=r.schema.names)

    for b in batches:
        known = b.filter(b.column(3).is_valid())
        if len(known):
            yield known
        b = b.filter(b.column(3).is_null())
        x = b.column(0).to_numpy()
        if not len(x):
            continue
        cut = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
        if x[0] != last:
            if n > 1 and not large:
                yield from give(held, False)
            held, n, large, last = [], 0, False, x[0]
        # The first group may go on from the batch before, the last into the next; those between are whole.
        held.append(b.slice(0, int(cut[1])))
        n += int(cut[1])
        if large or n > most:
            yield from give(held, True)
            held, large = [], True
        if len(cut) > 2:
            if n > 1 and not large:
                yield from give(held, False)
            sizes, middle = np.repeat(np.diff(cut), np.diff(cut)), np.arange(int(cut[1]), int(cut[-2]))
            for flag in (False, True):
                some = middle[(sizes[middle] > 1) & ((sizes[middle] > most) == flag)]
                if len(some):
                    yield from give([b.take(pa.array(some))], flag)
            held, n, large, last = [b.slice(int(cut[-2]))], int(cut[-1] - cut[-2]), False, x[-1]
            if n > most:
                yield from give(held, True)
                held, large = [], True
    if n > 1 and not large:
        yield from give(held, False)


class Out:
    """Rows (bucket, tag, text, k, first, end) on their way out, passed on in batches of bounded size.

    Tag 0: the text of some windows, the first of which begins at ``first``. Tag 2: the same, known to be repeated. Tag 3: a
    span first-end that goes; it travels under a key of its own.
    """

    names = ("bucket", "tag", "text", "k", "first", "end")
    schema = "bucket long, tag int, text binary, k binary, first long, end long"

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def text(self, bucket: int, tag: int, text: bytes, k: bytes, first: int) -> None:
        self.rows.append((bucket, tag, text, k, first, 0))
        self.size += len(text)

    def span(self, k: bytes, first: int, end: int) -> None:
        last = self.rows[-1] if self.rows else None
        if last and last[1] == 3 and last[3] == k and last[4] <= first <= last[5]:
            self.rows[-1] = (*last[:5], max(end, last[5]))
        else:
            self.rows.append((int.from_bytes(k[:8], "little", signed=True), 3, None, k, first, end))

    def full(self) -> bool:
        return len(self.rows) >= ROWS_OUT or self.size >= BYTES_OUT

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(list(zip(*self.rows)) or [()] * 6, kinds)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, names=self.names)


def content_key(*parts: bytes) -> int:
    h = xxhash.xxh64()
    for p in parts:
        h.update(p)
    return h.intdigest() - (1 << 63)


def parts_of(data: memoryview, gram: int, first: int, n: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last): the windows of a run of a large bucket, parted by the place of the k-gram and shared content."""
    t = np.frombuffer(data[first : first + n - 1 + length], U8)
    place = U64((1 << PLACE_BITS) - 1)
    at = np.flatnonzero((gram_hashes(t) >> U64(1)) | place == (U64(gram & 0xFFFFFFFFFFFFFFFF) >> U64(1)) | place)
    p = at[np.searchsorted(at, np.arange(n))]
    part = (p - np.arange(n)) // PART
    head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (part[1:] != part[:-1])]))
    name = gram.to_bytes(8, "little", signed=True)
    for a, z, q, j in zip(head.tolist(), (np.append(head[1:], n) - 1).tolist(), p[head].tolist(), part[head].tolist()):
        shared = first + q - PART * j
        yield content_key(name, bytes((j,)), data[shared : shared + length - PART + 1]), first + a, first + z


def with_text(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (k, b, runs(run, bucket, gram), ...): rows of ``Out``.

    Parts of large buckets that a task sees more than once are settled there, and leave it once.
    """
    out, seen, size = Out(), {}, 0

    def parts_out() -> Iterator[pa.RecordBatch]:
        for (bucket, text), (k, first, many) in seen.items():
            out.text(bucket, 2 if many else 0, text, k, first)
            if out.full():
                yield out.batch()
        seen.clear()

    for b in batches:
        lists = b.column(2)
        lengths = lists.value_lengths().fill_null(0).to_numpy()
        run, bucket, gram = lists.flatten().flatten()
        run, bucket, large, gram = run.to_numpy(), bucket.to_numpy(), gram.is_valid().to_numpy(False), gram.fill_null(0).to_numpy()
        ends = np.cumsum(lengths)
        for row in np.flatnonzero(lengths).tolist():
            k, data = b.column(0)[row].as_py(), memoryview(b.column(1)[row].as_buffer())
            mine = np.arange(ends[row] - lengths[row], ends[row])
            mine = mine[np.argsort(run[mine], kind="stable")]  # spans that touch are one
            for r, bu, is_large, g in zip(run[mine].tolist(), bucket[mine].tolist(), large[mine].tolist(), gram[mine].tolist()):
                first, n = r >> 16, (r & 0xFFFF) + 1
                if not is_large:
                    out.text(bu, 0, bytes(data[first : first + n - 1 + length]), k, first)
                else:
                    for key, a, z in parts_of(data, g, first, n, length):
                        text = bytes(data[a : z + length])
                        met = seen.get((key, text))
                        if met is None:
                            seen[key, text] = [k, a, False]
                            size += len(text)
                            continue
                        if not met[2]:
                            met[2] = True
                            out.span(met[0], met[1], met[1] + len(text))
                        out.span(k, a, z + length)
                        if out.full():
                            yield out.batch()
                if out.full():
                    yield out.batch()
                if size >= BYTES_OUT:
                    yield from parts_out()
                    size = 0
    yield from parts_out()
    yield out.batch()


def sort_block(rows: list[list], length: int, out: Out) -> None:
    """Spans of what repeats in rows [bucket, text, k, first, known]; the texts of a bucket differ, known ones are settled."""
    texts = [r[1] for r in rows]
    lengths = np.array([len(x) for x in texts])
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = lengths - length + 1
    # A bucket of one text needs no sorting.
    buckets = np.array([r[0] for r in rows])
    same = np.concatenate([[False], buckets[1:] == buckets[:-1]])
    at = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
    if not len(at):
        return
    starts = np.concatenate([np.arange(base[i], base[i] + counts[i]) for i in at])
    hit = repeated(np.frombuffer(b"".join(texts), U8), starts, length)
    for i, part in zip(at.tolist(), np.split(hit, np.cumsum(counts[at])[:-1])):
        _, _, k, first, known = rows[i]
        for a, z in runs(part) if not known else ():
            out.span(k, first + a, first + z + length)


def spans_of(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """Spans, tag 3, of what is repeated, from rows of ``Out`` sorted by bucket, text and tag.

    A text that stands there twice is settled at once, so only different ones are held. A bucket with over ``block`` bytes of
    them is not sorted: their windows go on as texts, each in a bucket of its own.
    """
    out, done, now, size, fresh = Out(), [], [], 0, 0
    last, row, large = None, None, False

    def windows(row: list) -> None:
        _, text, k, first, known = row
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            out.text(content_key(w), 2 if known else 0, w, k, first + i)

    for b in batches:
        for bucket, tag, text, k, first, end in zip(*(c.to_pylist() for c in b.columns)):
            if tag == 3:
                out.span(k, first, end)
            elif bucket == last and text == row[1]:
                if not row[4]:
                    row[4] = True
                    out.span(row[2], row[3], row[3] + len(text))
                out.span(k, first, first + len(text))
            else:
                if large:
                    windows(row)
                if bucket != last:
                    done, size = done + now, size + fresh
                    now, fresh, last, large = [], 0, bucket, False
                    if size >= SORTED_BYTES:
                        sort_block(done, length, out)
                        done, size = [], 0
                row = [bucket, text, k, first, tag == 2]
                if not large:
                    now.append(row)
                    fresh += len(text)
                    if fresh > block:
                        for r in now[:-1]:
                            windows(r)
                            if out.full():
                                yield out.batch()
                        now, fresh, large = [], 0, True
            if out.full():
                yield out.batch()
    if large:
        windows(row)
    sort_block(done + now, length, out)
    yield out.batch()


def equal_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(k, start, end) of all spans, and of the single windows that repeat, from rows of ``Out`` sorted by bucket, text and tag."""
    out, one, text, known = Out(), None, None, False
    for b in batches:
        for _, tag, x, k, first, end in zip(*(c.to_pylist() for c in b.columns)):
            if tag == 3:
                out.span(k, first, end)
                continue
            if x != text:
                text, one, known = x, (k, first), tag == 2
                if known:
                    out.span(k, first, first + length)
                continue
            if not known:
                out.span(*one, one[1] + length)
                known = True
            out.span(k, first, first + length)
            if out.full():
                yield out.batch().select(["k", "first", "end"])
        if out.full():
            yield out.batch().select(["k", "first", "end"])
    yield out.batch().select(["k", "first", "end"])


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    most: int = MOST,
    block: int = BLOCK,
    least: int = LEAST,
    **derived,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, removed (start, end in bytes), kept (the bytes that are left).

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in any text. A null text is empty. Null ids are
    kept. Repeated rows are copies of each other, as are rows of equal text: these are told by 128 bits of SHA-256; all else is
    compared byte by byte. ``length`` is at least 64. Texts may be of any length: they are hashed and sent on in slices. Other
    columns are not read. Of no rows come no rows. No result depends on ``most``, ``block`` and ``least``, from which on
    buckets are split and k-grams frequent. Columns ``derived`` from n_bytes, removed and kept may be asked for in place of
    these; they are made once for all copies of a text, before its bytes travel on.
    """
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    often = shipped(docs.sparkSession, frequent_grams(docs.select(text.alias("b")), length, least))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("b")).withColumn("k", F.unhex(F.substring(F.sha2("b", 256), 1, 32)))
    classes = rows.groupBy("k").agg(F.min("b").alias("b"), F.count("*").alias("n"))
    found = classes.mapInArrow(lambda it: occurrences(it, length, often), "bucket long, k binary, run long, gram long")
    found = found.repartition("bucket").sortWithinPartitions("bucket")
    found = found.mapInArrow(lambda it: repeating(it, most), "bucket long, k binary, run long, gram long")
    by_text = found.groupBy("k").agg(F.collect_list(F.struct("run", "bucket", "gram")).alias("runs"))
    # Left joins and all columns, here and below: the texts' shuffle is then the same one in all three uses.
    texts = classes.join(by_text, "k", "left").select("k", "b", "runs", "n")
    windows = texts.mapInArrow(lambda it: with_text(it, length), Out.schema)
    windows = windows.repartition("bucket").sortWithinPartitions("bucket", "text", "tag")
    windows = windows.mapInArrow(lambda it: spans_of(it, length, block), Out.schema)
    windows = windows.repartition("bucket").sortWithinPartitions("bucket", "text", "tag")
    spans = windows.mapInArrow(lambda it: equal_windows(it, length), "k binary, first long, end long")
    spans = spans.groupBy("k").agg(F.collect_list(F.struct("first", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            counts = b.column(3).value_lengths().fill_null(0).to_numpy()
            first, end = (c.to_numpy() for c in b.column(3).flatten().flatten())
            upto = np.cumsum(counts)
            for i, (data, copies) in enumerate(zip(b.column(1), b.column(2).to_pylist())):
                data = data.as_py()
                n.append(len(data))
                a, e = first[upto[i] - counts[i] : upto[i]], end[upto[i] - counts[i] : upto[i]]
                if copies > 1 and len(data) >= length:
                    a, e = np.zeros(1, np.int64), np.full(1, len(data))
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, e = a[order], np.maximum.accumulate(e[order])
                    new = np.concatenate([[True], a[1:] > e[:-1]])
                    a, e = a[new], e[np.concatenate([new[1:], [True]])]
                removed.append((a, e))
                ends = [0, *np.column_stack([a, e]).ravel().tolist(), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(ends[::2], ends[1::2])))
            flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *(r[i] for r in removed)])) for i in (0, 1)]
            spots = pa.array(np.cumsum([0, *(len(a) for a, _ in removed)]), pa.int32())
            lists = pa.ListArray.from_arrays(spots, pa.StructArray.from_arrays(flat, names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), lists, pa.array(kept, pa.binary())], names=["k", "n_bytes", "removed", "kept"])

    results = classes.join(spans, "k", "left").select("k", "b", "n", "spans")
    results = results.mapInArrow(cut, "k binary, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    wanted = derived or {c: F.col(c) for c in ("n_bytes", "removed", "kept")}
    results = results.select("k", *(c.alias(name) for name, c in wanted.items()))
    return rows.select("doc_id", "k").join(results, "k").select(F.col("doc_id").cast(kind), *wanted)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return deduplicate(
        table(spark, sf_dir, "documents"),
        n_bytes=F.col("n_bytes"),
        n_removed=total,
        n_spans=F.size("removed").cast("long"),
        kept_sha256=F.sha2("kept", 256),
    )
