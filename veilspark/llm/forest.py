"""MinHash near-duplicates by an LSH forest.

A set of shingles has a signature of least hashes, dealt to trees: in each tree a path of digits, one a least hash. The paths of a
tree, sorted, are its order; rows that share their first digits lie side by side, and the longer the common prefix of two paths, the
more alike the sets are likely to be. A region is a run of rows that share a prefix: ``LEAST`` digits where that leaves few rows
together, and more where rows crowd, up to the whole path.

Links are sought in three steps, each among what the last has left apart. First every set is held against its
neighbour by the longest common prefixes over all trees; then every two neighbours that have found different sets are; and
last come all pairs of a region that are of different components and whose signatures agree enough. Only the first two steps move texts, a
pair at a time for each set; in the last, sets travel to their region and only links between components leave it. Every link is confirmed on
full sets. Copies are one node, named by 128 bits of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, components, joined_once, row_key, table, written
from .simhash import FULL, group_starts, mixed, whole_tables

WORDS = 5
#: A link is a pair whose common shingles are so many in a hundred of all that either has.
PERCENT = 85
#: Trees, digits of a path and bits of a digit; 26 trees of four digits share no prefix for 5 in a billion pairs of similarity 0.85, and of
#: six digits, where rows crowd, for 5 in a million.
TREES, DEPTH, BITS = 26, 6, 10
LEAST = 4
#: Rows from which on a region takes one more digit.
DENSE = 256
#: Rows of a piece of a region, in the first steps and in the last.
PIECE, SETS = 1024, 1024
#: Of the digits of two signatures so many agree for sets of similarity 0.85, less six deviations: 132.6 on average, deviation 4.5.
AGREE = 106
#: Words, and digits of pairs, that are worked on at once.
BLOCK = 1 << 16
FACTORS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) + np.uint64(1 << 20)) | np.uint64(1)
DIGITS = np.arange(DEPTH - 1, -1, -1) * BITS


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased: of a short text the one of all its words, else none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], np.uint64)
    found = []
    for a in range(0, len(w) - words + 1, BLOCK):
        part = w[a : a + BLOCK + words - 1]
        found.append(np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in map(b" ".join, zip(*(part[i:] for i in range(words))))], np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def paths_of(hashes: np.ndarray) -> np.ndarray:
    """The path of a set in each tree: digits of its least hashes by as many orders, the first digit the highest."""
    least = np.full(len(FACTORS), FULL)
    for a in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[None, a : a + 512] * FACTORS[:, None]).min(axis=1))
    digits = (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.int64).reshape(TREES, DEPTH)
    return (digits << DIGITS).sum(axis=1)


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many digits of two arrays of paths agree, row by row."""
    differ = left ^ right
    return sum(((differ >> int(s)) & ((1 << BITS) - 1) == 0).sum(axis=-1) for s in DIGITS)


def sizes_fit(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def marks(src: DataFrame, words: int) -> DataFrame:
    """(doc_id, __id, __hash, same, n_shingles, paths) of ``src(doc_id, __id, __hash, text)``; ``same`` names the set."""
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "__id", "__hash", "same", "n_shingles", "paths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, n, paths = [], [], [np.zeros(0, np.int64)]
            for t in b.column(3):
                s = shingles(t.as_py(), words)
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                n.append(len(s))
                paths.append(paths_of(s))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TREES, pa.int32()), pa.array(np.concatenate(paths)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(same, pa.binary()), pa.array(n, pa.int64()), lists], names=names)

    schema = f"doc_id {kind}, __id string, __hash long, same binary, n_shingles long, paths array<bigint>"
    return src.select("doc_id", "__id", "__hash", "text").mapInArrow(run, schema)


def prefix(digits: int) -> Column:
    return F.shiftright("path", BITS * (DEPTH - digits))


def in_regions(rows: DataFrame, digits: int) -> DataFrame:
    """``rows(tree, path, ...)`` that share so many digits with another, with region and ``together``, the number of rows that do."""
    rows = rows.withColumn("region", prefix(digits))
    many = rows.groupBy("tree", "region").agg(F.count("*").alias("together")).where("together > 1")
    return rows.join(many, ["tree", "region"])


def best_of(pairs: DataFrame, ends: tuple[str, str], score: str = "score") -> DataFrame:
    """Of ``pairs(u, v, ...)`` the best one for each end."""
    one, two = ends
    each = pairs.select(F.explode(F.array(one, two)).alias("end"), F.struct(score, "u", "v").alias("pair"))
    return each.groupBy("end").agg(F.max("pair").alias("pair")).select("pair.u", "pair.v").distinct()


def neighbours(rows: DataFrame) -> DataFrame:
    """(u, v, part_u, part_v, score): rows of different parts that stand side by side, in the orders of all trees, with the digits
    that they have in common there. A region of many rows has several orders, of some rows each."""
    piece = F.pmod(F.xxhash64("id"), F.ceil(F.col("together") / PIECE).cast("long"))
    order = Window.partitionBy("tree", "region", "piece").orderBy("path", "id")
    here, last = F.struct("id", "part", "path"), F.lag(F.struct("id", "part", "path")).over(order)
    pairs = rows.withColumn("piece", piece).select(here.alias("x"), last.alias("y")).where("x.part != y.part")
    differ = F.col("x.path").bitwiseXOR(F.col("y.path"))
    common = F.lit(LEAST)
    for d in range(LEAST + 1, DEPTH + 1):
        common += F.when(F.shiftright(differ, BITS * (DEPTH - d)) == 0, 1).otherwise(0)
    a, b = F.least("x", "y"), F.greatest("x", "y")
    pairs = pairs.select(a["id"].alias("u"), b["id"].alias("v"), a["part"].alias("part_u"), b["part"].alias("part_v"), common.alias("score"))
    return pairs.groupBy("u", "v", "part_u", "part_v").agg(F.sum("score").alias("score"))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(u, v)`` whose sizes and signatures do not tell that they are no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy() for i in (2, 4))
            left, right = (b.column(i).flatten().to_numpy().reshape(-1, TREES) for i in (3, 5))
            ok = pa.array(sizes_fit(n, m, percent) & (agreeing(left, right) >= AGREE))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in (0, 1)], names=["u", "v"])

    for at in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("id").alias(at), F.col("n_shingles").alias(f"n_{at}"), F.col("paths").alias(f"paths_{at}")), at)
    return pairs.select("u", "v", "n_u", "paths_u", "n_v", "paths_v").mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs(u, v)`` whose sets, made from ``texts(id, text)``, are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in batches:
            keep = []
            for i, (u, a, c) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3))):
                if u != last:
                    last, left = u, shingles(a.as_py(), words)
                if linked(left, shingles(c.as_py(), words), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in (0, 1)], names=["u", "v"])

    for at in ("v", "u"):
        pairs = pairs.join(texts.select(F.col("id").alias(at), F.col("text").alias(f"text_{at}")), at)
    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def several_parts(rows: DataFrame, region: list[str]) -> DataFrame:
    """``rows(..., part)`` of the regions that have more than one part, with ``together``, their number."""
    seen = rows.groupBy(*region).agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("together"))
    return rows.join(seen.where("low != high").drop("low", "high"), region)


def units(rows: DataFrame) -> DataFrame:
    """``rows(tree, path, id, part)`` with the units in which they are compared: digits, region, a, b, and their piece p.

    A region of over ``DENSE`` rows takes one more digit. One that has the whole path in common is cut into pieces, and each two of
    them are a unit; so a row of such a region of K rows travels K / ``SETS`` times.
    """
    out, left = None, rows
    for d in range(LEAST, DEPTH + 1):
        left = several_parts(left.withColumn("region", prefix(d)).withColumn("digits", F.lit(d)), ["tree", "region"])
        left = checkpoint(left)
        done = left if d == DEPTH else left.where(F.col("together") <= DENSE)
        out = done if out is None else out.unionByName(done)
        left = left.where(F.col("together") > DENSE).drop("region", "digits", "together")
        if d < DEPTH and left.isEmpty():
            break
    pieces = F.ceil(F.col("together") / SETS).cast("int")
    out = out.withColumn("pieces", F.when(F.col("together") > DENSE, pieces).otherwise(1))
    out = out.withColumn("p", F.pmod(F.xxhash64("id"), "pieces").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    unit = F.col("tree") * 8 + F.col("digits")
    return out.select(unit.alias("tree"), "region", F.least("p", "other").alias("a"), F.greatest("p", "other").alias("b"), "p", "id", "part")


UNIT = ["tree", "region", "a", "b"]


def pairs_in(m: np.ndarray, paths: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a unit, columns of m: tree, region, a, b, p, id, part, n, that may be links between its parts, sorted by part.

    A pair whose whole paths agree in some tree, and so meets there for certain, is one of the first such tree only.
    """
    size, tree = m.shape[1], int(m[0, 0]) // 8
    starts = np.flatnonzero(np.r_[True, m[6, 1:] != m[6, :-1]])
    later = np.repeat(np.r_[starts[1:], size], np.diff(np.r_[starts, size]))
    step = max(1, (BLOCK << 4) // (size * TREES))
    for a in range(0, size, step):
        i = np.repeat(np.arange(a, min(a + step, size)), size - later[a : a + step])
        j = np.concatenate([np.arange(x, size) for x in later[a : a + step].tolist()])
        ok = sizes_fit(m[7, i], m[7, j], percent) & ((m[2, i] == m[3, i]) | (m[4, i] != m[4, j]))
        i, j = i[ok], j[ok]
        for k in range(0, len(i), step * size):
            x, y = i[k : k + step * size], j[k : k + step * size]
            near = agreeing(paths[x], paths[y]) >= AGREE
            x, y = x[near], y[near]
            whole = paths[x] == paths[y]
            mine = ~whole.any(axis=1) | (whole.argmax(axis=1) == tree)
            yield x[mine], y[mine]


def in_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole units: the rows, their first eight columns and their paths."""
    for t in whole_tables(batches, len(UNIT)):
        m = np.stack([t.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)])
        paths = t.column(8).flatten().to_numpy().reshape(-1, TREES)
        start = group_starts(m, len(UNIT)).tolist()
        for a, z in zip(start, [*start[1:], len(t)]):
            if z - a > 1:
                yield t.slice(a, z - a), m[:, a:z], paths[a:z]


def across(rows: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): parts of ``rows(tree, path, id, part)`` that a link connects, so that all parts are connected that pairs of one region connect.

    First paths alone travel to the units and single out the sets that may have a link there; then these sets do, as all their hashes.
    In a unit, a pair whose ends links found before connect there already is not compared.
    """
    numbers = [*UNIT, "p", "id", "part", "n_shingles"]
    schema = ", ".join(f"{c} {'int' if c in ('tree', 'a', 'b', 'p') else 'long'}" for c in numbers) + ", paths array<bigint>"

    def single_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, m, paths in in_units(batches):
            near = np.zeros(len(t), bool)
            for x, y in pairs_in(m, paths, percent):
                near[x] = near[y] = True
            if near.any():
                yield t.filter(pa.array(near))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([shingles(x.as_py(), words).tobytes() for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), made], names=["id", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, m, paths in in_units(batches):
            part, found = m[6].copy(), []
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(9)]
            for x, y in pairs_in(m, paths, percent):
                for i, j in zip(x.tolist(), y.tolist()):
                    if part[i] != part[j] and linked(hashes[i], hashes[j], percent):
                        found.append((int(m[6, i]), int(m[6, j])))
                        part[part == part[j]] = part[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    marked = units(rows).join(nodes.select("id", "n_shingles", "paths"), "id").select(*numbers, "paths")
    some = checkpoint(marked.repartition(*UNIT).sortWithinPartitions(*UNIT, "part", "id").mapInArrow(single_out, schema))
    wanted = written(some.select("id").distinct(), "forest")
    held = written(texts.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(sets, "id long, hashes binary"), "forest")
    met = some.join(held, "id").select(*numbers, "paths", "hashes")
    return met.repartition(*UNIT).sortWithinPartitions(*UNIT, "part", "id").mapInArrow(compare, "u long, v long")


def rooted(nodes: DataFrame, texts_of, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, root) of ``nodes(id, n_shingles, paths)`` that are linked: nodes of one component have one root. ``texts_of(ids)`` gives (id, text)."""
    rows = nodes.select("id", F.posexplode("paths").alias("tree", "path"))
    rows = checkpoint(in_regions(rows, LEAST))
    texts = written(texts_of(rows.select("id").distinct()), "forest")

    def held(pairs: DataFrame) -> DataFrame:
        return checkpoint(confirmed(checkpoint(likely(pairs, nodes, percent)), texts, words, percent))

    def labelled(parts: DataFrame) -> DataFrame:
        met = rows.drop("together").join(written(parts, "forest"), "id", "left").withColumn("part", F.coalesce("part", "id"))
        return checkpoint(several_parts(met, ["tree", "region"]))

    found = held(best_of(neighbours(rows.withColumn("part", F.col("id"))), ("u", "v")))
    # Sets that found the same one need not be held against each other; whole components are not needed for that.
    ends = found.select(F.explode(F.array(F.struct(F.col("u").alias("id"), "v"), F.struct(F.col("v").alias("id"), F.col("u").alias("v")))).alias("e"))
    hooked = ends.groupBy("e.id").agg(F.min("e.v").alias("v")).select("id", F.least("id", "v").alias("part"))
    side_by_side = neighbours(labelled(hooked)).groupBy("part_u", "part_v").agg(F.max(F.struct("score", "u", "v")).alias("pair")).select("pair.*")
    found = found.unionByName(held(side_by_side.select("u", "v").distinct()))
    parts = checkpoint(components(found).select(F.col("node").alias("id"), F.col("root").alias("part")))
    last = checkpoint(across(labelled(parts).select("tree", "path", "id", "part"), nodes, texts, words, percent))
    if last.isEmpty():
        return parts.withColumnRenamed("part", "root")
    roots = components(last)  # of components: these are few
    every = nodes.select("id").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    return every.join(written(roots, "forest"), F.col("part") == F.col("node"), "left").select("id", F.coalesce("root", "part").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, the smallest doc_id reachable by links, and kept.

    A null text, or one without a word, has no shingle, is linked with nothing and is kept. Rows alike in text are linked like any; repeated
    rows and ids give a row each. A null id takes part in the links; a component of null ids only has the component_id null. Of a component the rows
    of its smallest id are kept. Texts of any length count with all their shingles. Other columns are not read. Of no rows come no rows.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.select("doc_id", *row_key(src), "text")
    rows = checkpoint(marks(src, words))
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "paths")]
    key = F.min(F.struct("__id", "__hash")).alias("key")
    nodes = rows.where("n_shingles > 0").groupBy("same").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), key, *firsts)
    nodes = checkpoint(nodes.withColumn("id", F.monotonically_increasing_id()))

    def texts_of(ids: DataFrame) -> DataFrame:
        # The documents travel once, by sorting whatever the size, to the sets that share a prefix with another.
        first = written(nodes.join(ids, "id", "left_semi").select("id", "key.__id", "key.__hash"), "forest")
        once = src.select("__id", "__hash", "text").dropDuplicates(["__id", "__hash"])
        return once.join(first.hint("merge"), ["__id", "__hash"]).select("id", "text")

    named = nodes.join(rooted(nodes, texts_of, words, percent), "id", "left").select("same", "low", "copies", F.coalesce("root", "id").alias("root"))
    named = checkpoint(named)
    low = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = joined_once(named, low, "root").select("same", "component_id", F.col("copies").alias("n"))
    some = joined_once(rows.where("n_shingles > 0").select("doc_id", "n_shingles", "same"), named, "same")
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", "same", F.col("doc_id").alias("component_id"))
    found = some.select("doc_id", "n_shingles", "same", "component_id").unionByName(none)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose ids are kept, and those without an id, with all their columns, which may have any name."""
    gone = near_duplicates(docs, id_col, text_col, **settings).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op11_lsh_forest(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT rid, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM s GROUP BY rid),
c AS (SELECT same, min(rid) AS rid, any_value(n) AS n FROM n GROUP BY same),
k AS (SELECT s.rid, s.g, c.n FROM s JOIN c ON s.rid = c.rid),
p AS (SELECT a.rid AS u, b.rid AS v FROM k a JOIN k b ON a.g = b.g AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
      GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
r(u, v) AS (SELECT rid, rid FROM c UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
m AS (SELECT u, min(v) AS root FROM r GROUP BY u),
o AS (SELECT d.doc_id, d.rid, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (same) LEFT JOIN m ON m.u = c.rid),
z AS (SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id FROM o)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM z
"""
