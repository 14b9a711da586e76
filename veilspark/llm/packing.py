"""Token ids packed into fixed-width rows by best-fit decreasing.

Every partition tokenises its documents, cuts those longer than a row into whole rows and a rest, and packs the pieces of a
bounded buffer: longest first, each into the open row whose free space fits it best, found with a segment tree over free
capacities. Each buffer becomes one shard file in the shared folder, so nothing is shuffled, memory is bounded by the buffer
and a lost executor only repeats its own shards, under the same names.

A shard is an ``.npz`` file: ``ids`` (rows x width), ``cu_seqlens`` (cumulative segment lengths, row after row, each from 0),
``row_ptr`` (where a row's entries begin in cu_seqlens), ``resets`` (bits of rows x width, set where positions restart at 0)
and ``pieces`` (document's ordinal in the shard, piece, row, start, length). Behind a row's last segment stand pad ids.
"""

from __future__ import annotations

import base64
import io
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, publish, table, work_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-tokeniser pattern that the vocabulary was made with, and its free id for the end of a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
WIDTH = 2048
SHARD_TOKENS = 4_000_000
#: Documents in a shard at most; those without a token fill no rows.
SHARD_DOCS = 100_000


class CapacityTree:
    """Open rows by free capacity; finds the smallest capacity that is at least a length."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        if len(self.rows[capacity]) == 1:
            self._count(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove a best-fitting row; its (capacity, row), or None if none is wide enough."""
        i = length + self.size
        while not self.tree[i]:
            while i & 1:  # a right child: what follows is right of the parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self._count(capacity, -1)
        return capacity, row

    def _count(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1


def best_fit_decreasing(lengths: list[int], width: int) -> tuple[list[tuple[int, int]], int]:
    """(row, start) of each length, and the number of rows; no length exceeds the width."""
    tree, n = CapacityTree(width), 0
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        capacity, row = tree.take(lengths[i]) or (width, n)
        n += row == n
        placed[i] = (row, width - capacity)
        if left := capacity - lengths[i]:
            tree.add(left, row)
    return placed, n


def pack_shard(docs: list[np.ndarray], width: int, pad: int, dtype) -> dict[str, np.ndarray]:
    """The arrays of a shard that holds the ids of ``docs``."""
    pieces = [(d, k, a, min(width, len(ids) - a)) for d, ids in enumerate(docs) for k, a in enumerate(range(0, len(ids), width))]
    placed, n = best_fit_decreasing([p[3] for p in pieces], width)
    out = np.full((n, width), pad, dtype)
    reset = np.zeros((n, width), bool)
    for (d, _, a, length), (row, start) in zip(pieces, placed):
        out[row, start : start + length] = docs[d][a : a + length]
        reset[row, start] = True
    t = np.array([(d, k, r, s, m) for (d, k, _, m), (r, s) in zip(pieces, placed)], np.int32).reshape(-1, 5)
    by_row = t[np.lexsort((t[:, 3], t[:, 2]))]
    counts = np.bincount(by_row[:, 2], minlength=n) + 1
    ptr = np.r_[0, np.cumsum(counts)]
    cu = np.zeros(int(ptr[-1]), np.int32)
    cu[np.setdiff1d(np.arange(len(cu)), ptr[:-1])] = by_row[:, 3] + by_row[:, 4]
    return {"ids": out, "cu_seqlens": cu, "row_ptr": ptr, "resets": np.packbits(reset, axis=1), "pieces": t}


def write_shard(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write under a hidden name, then rename; the name is the attempt's own."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    publish(folder, name + ".npz", held.getvalue())


def read_shard(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{name}.npz") as f:
        return dict(np.load(io.BytesIO(f.read())))


def encoder(vocabulary: bytes, pattern: str):
    """The tokeniser of a ``.tiktoken`` vocabulary's bytes."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str) -> np.ndarray:
    if not text.isascii():
        text = text.encode("utf-8", "replace").decode()  # a lone surrogate has no ids
    return enc.encode_to_numpy(text, disallowed_special=())


def pack(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    width: int = WIDTH,
    end: int | None = END,
    pad: int = END,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Tokenise and pack ``docs`` into shard files below ``folder`` (a URI); one row for each document.

    doc_id, n_tokens (ids of the text, without the end mark), n_pieces, shard, and pieces: (row, start, length), in the
    order of the text. A null or empty text has no ids and no piece, and its shard is null. Repeated rows are packed again;
    rows with a null id are packed too. Pieces of equal length keep the order of their documents. A text of any length is cut
    into whole rows and a rest, none of it is left out; it is tokenised as a whole, in the memory of one task. Other columns
    are not read. Of no rows come no rows and no files.

    A shard's name has the attempt of the task that wrote it, and only shards that the rows name count: a second attempt, which may see
    its rows in another order, writes others and names those.
    """
    run_id = uuid.uuid4().hex[:8]
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under a MB
    top = max(end or 0, pad, held.value.count(b"\n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dtype = encoder(held.value, pattern), np.uint16 if top < 1 << 16 else np.uint32
        tail = np.array([] if end is None else [end], dtype)
        shards, task = itertools.count(), TaskContext.get()
        part = f"{task.partitionId():06d}-{run_id}-{task.taskAttemptId()}"
        ids: list[pa.Scalar] = []
        sizes: list[int] = []
        buffer: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            arrays = pack_shard(buffer, width, pad, dtype)
            name = f"{part}-{next(shards):05d}"
            if len(arrays["ids"]):
                write_shard(folder, name, arrays)
            t = arrays["pieces"]
            counts = np.bincount(t[:, 0], minlength=len(buffer)) if len(buffer) else np.zeros(0, int)
            spots = pa.StructArray.from_arrays([pa.array(t[:, i]) for i in (2, 3, 4)], names=["row", "start", "length"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), spots)
            columns = [
                pa.array([x.as_py() for x in ids], ids[0].type),
                pa.array(sizes, pa.int64()),
                pa.array(counts, pa.int32()),
                pa.array([name if c else None for c in counts], pa.string()),
                lists,
            ]
            ids.clear(), sizes.clear(), buffer.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_pieces", "shard", "pieces"])

        held_tokens = 0
        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                got = encode(enc, text).astype(dtype) if text else np.zeros(0, dtype)
                ids.append(i)
                sizes.append(len(got))
                buffer.append(np.concatenate([got, tail]) if len(got) else got)
                held_tokens += len(got)
                if held_tokens >= shard_tokens or len(ids) >= SHARD_DOCS:
                    yield flush()
                    held_tokens = 0
        if ids:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, n_tokens long, n_pieces int, shard string, pieces array<struct<row:int,start:int,length:int>>"
    return src.mapInArrow(run, schema)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pack every document; doc_id, n_tokens, n_pieces, shard and pieces."""
    return pack(table(spark, sf_dir, "documents"), work_dir(spark, "packed"))
