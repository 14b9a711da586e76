"""A Merkle manifest of a dataset: one digest that vouches for every row, and for each row a proof.

A row's leaf is the SHA-256 of its columns. Within a group, such as a source, leaves stand in order and have a number; runs of
``fanout`` numbers hash into a parent, level by level, until the group has one node left, its subroot. Subroots, in order of their
groups, are the leaves of one more tree, whose last node is the root.

Every level is one grouped DataFrame: numbers divided by the fanout, the children of a number as a sorted array, hashed. A proof
is gathered from the top: a node's path is its siblings followed by its parent's path, so a level joins as many rows as it has
parents, and only in the last projection does a leaf meet the whole of its path. No text and no path of a leaf is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc32_sql, numbered, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of the documents' ids a share of one in so many is tampered with by the query.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<before:string,after:string>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: ``-`` for each null, else the number of UTF-8 bytes, a colon and the value."""
    shown = [c.cast("string") for c in columns]
    return sha(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown))


@dataclass
class Tree:
    """Levels from the leaves up, each with a row for a run of nodes: grp, up (the run's number), kids (hash and item, in order), n
    (how many runs the group has there) and hash; and the top nodes: grp, hash, depth (the levels below), and the item of a lone leaf."""

    fanout: int
    levels: list[DataFrame]
    tops: DataFrame


def grow(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """The trees of ``leaves(grp, idx, n, hash, item)``, all groups at once, a level at a time.

    ``idx`` counts a group's leaves from 0 on and ``n`` is how many it has. A lone leaf is the top of its group. A last run may be
    short, down to a single node, which is hashed as well.
    """
    none = F.lit(None).cast(leaves.schema["item"].dataType).alias("item")
    levels, nodes = [], leaves
    tops = nodes.where("n = 1").select("grp", "hash", F.lit(0).alias("depth"), "item")
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = F.floor(F.col("idx") / fanout).cast("long").alias("up")
        kids = F.sort_array(F.collect_list(F.struct("idx", "hash", "item"))).alias("kids")  # at most ``fanout``
        runs = nodes.where("n > 1").groupBy("grp", up).agg(kids, F.ceil(F.max("n") / fanout).cast("long").alias("n"))
        runs = runs.withColumn("kids", F.transform("kids", lambda k: k.dropFields("idx")))
        levels.append(runs := checkpoint(runs.withColumn("hash", F.sha2(F.array_join("kids.hash", ""), 256))))
        most = -(-most // fanout)
        nodes = runs.select("grp", F.col("up").alias("idx"), "n", "hash", none)
        tops = tops.unionByName(nodes.where("n = 1").select("grp", "hash", F.lit(len(levels)).alias("depth"), "item"))
    return Tree(fanout, levels, tops)


def paths(tree: Tree, starts: DataFrame) -> DataFrame:
    """(grp, item, hash, path, top) of every leaf; ``starts(grp, path)`` says how each group's path goes on above its top.

    A path is an array of what stands before and after a node in its run, from the leaf's level to the last.
    """
    tops = tree.tops.withColumnRenamed("hash", "top").join(starts, "grp")
    found = tops.where("depth = 0").select("grp", "item", F.col("top").alias("hash"), "path", "top")
    above = None
    for depth in range(len(tree.levels), 0, -1):
        ended = tops.where(F.col("depth") == depth).select("grp", F.lit(0).cast("long").alias("up"), "path", "top")
        above = ended if above is None else above.unionByName(ended)
        runs = tree.levels[depth - 1].select("grp", "up", "kids").join(above, ["grp", "up"])
        runs = runs.select("*", F.posexplode("kids").alias("at", "kid"))
        hashes, at = F.col("kids.hash"), F.col("at")
        before, after = F.slice(hashes, 1, at), F.slice(hashes, at + 2, F.size("kids"))
        own = F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))
        above = runs.select("grp", (F.col("up") * tree.fanout + at).alias("up"), "kid.*", F.concat(F.array(own), "path").alias("path"), "top")
        if depth == 1:
            return found.unionByName(above.select(*found.columns))
        above = checkpoint(above.select("grp", "up", "path", "top"))  # as many rows as there are runs below; plans stay small
    return found


@dataclass
class Manifest:
    """``trees`` has a tree for each group, ``over`` the one tree over their subroots; ``root`` is None where there are no rows."""

    trees: Tree
    over: Tree
    root: str | None

    def subroots(self) -> DataFrame:
        """(grp, hash): the subroot of each group, which is named as ``group_name`` does."""
        return self.trees.tops.select("grp", "hash")

    def proofs(self) -> DataFrame:
        """(grp, item, hash, path, subroot) of every row: folding a hash along its path gives the root."""
        none = F.array().cast(f"array<{STEP}>")
        starts = paths(self.over, self.over.tops.select("grp", none.alias("path"))).select(F.col("item.grp").alias("grp"), "path")
        return paths(self.trees, checkpoint(starts)).withColumnRenamed("top", "subroot")


def group_name(group: Column) -> Column:
    """A name that is never null and sorts as groups do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(rows: DataFrame, group: Column, order: list[Column], leaf: Column, item: Column, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``rows``: ``leaf`` is a row's digest, ``item`` what its proof is to carry.

    A null group is one of its own, the first. Rows that the order does not tell apart stand by their digests; alike rows are leaves of their own.
    Nulls of the order come first. Of no rows the root is None.
    """
    keys = [c.alias(f"o{i}") for i, c in enumerate(order)]
    leaves = checkpoint(rows.select(group_name(group).alias("grp"), *keys, leaf.alias("hash"), item.alias("item")))
    names = [f"o{i}" for i in range(len(order))]
    trees = grow(numbered(leaves, "grp", [*names, "hash"]).select("grp", "idx", "n", "hash", "item"), fanout)
    tops = numbered(trees.tops.select(F.lit("").alias("all"), "grp", "hash"), "all", ["grp"])
    over = grow(tops.select(F.col("all").alias("grp"), "idx", "n", "hash", F.struct("grp").alias("item")), fanout)
    root = over.tops.first()
    return Manifest(trees, over, root and root["hash"])


def folded(hash_: Column, path: Column) -> Column:
    """The root that a leaf and its path come to."""
    return F.aggregate(path, hash_, lambda acc, x: sha(x["before"], acc, x["after"]))


def verified_rows(
    docs: DataFrame, changed: dict[str, Column], columns: tuple = COLUMNS, group_col: str = "source", id_col: str = "doc_id", fanout: int = FANOUT
) -> DataFrame:
    """One row for each of ``docs``: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is of ``docs`` as they are; ``changed`` gives columns another value, and each row so changed is then held against
    the manifest by its proof. Null columns count as ``-``, an empty text is ``0:``; a null source is a source, the first, and null ids
    come first. Rows of one id stand by their digests, repeated rows are leaves of their own. A single row is its own subroot and
    root, and its proof is of nothing. Texts of any length are hashed as a whole, and are not shuffled. Other columns are not read, and may have any
    name. Of no rows come no rows.
    """
    kept = [F.col(f"`{c}`") for c in columns]
    now = [changed.get(c, F.col(f"`{c}`")) for c in columns]
    item = F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{group_col}`").cast("string").alias("source"), leaf_of(now).alias("now"))
    made = manifest(docs, F.col(f"`{group_col}`"), [F.col(f"`{id_col}`")], leaf_of(kept), item, fanout)
    beside = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    root = F.lit(made.root).cast("string")
    found = made.proofs().select(
        "item.doc_id",
        "item.source",
        F.col("hash").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.sha2(beside, 256).alias("proof_sha256"),
        folded(F.col("item.now"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(id_: Column, text: Column) -> Column:
    """The text, its A-Z lower-cased where ``TAMPERED`` divides the CRC-32 of the decimal id."""
    hit = F.crc32(id_.cast("string").cast("binary")) % TAMPERED == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and what it folds to after the tampering."""
    changed = {"text": tampered(F.col("doc_id"), F.col("text"))}
    return verified_rows(table(spark, sf_dir, "documents"), changed).drop("source")


def _sql(deep: int = 6, over: int = 3) -> str:
    """The same for DuckDB: ``deep`` levels for a source, up to 16 to the sixth documents, and ``over`` levels above."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in (*COLUMNS[:-1], text)) + ")"
    steps = [
        f"""d AS (SELECT row_number() OVER () AS rid, *, source AS s, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % {TAMPERED} = 0
        THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS now FROM documents)""",
        "t0 AS (SELECT rid, s, leaf, now, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d)",
        "n0 AS (SELECT s, i, h, count(*) OVER (PARTITION BY s) AS n FROM t0)",
    ]
    climb = lambda src, to: f"""{to} AS (SELECT s, CASE WHEN n > 1 THEN i // {FANOUT} ELSE i END AS i,
        CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, any_value(n) AS m FROM {src} GROUP BY s, n, 2)"""  # noqa: E731
    for k in range(deep):
        steps.append(climb(f"n{k}", f"u{k}"))
        steps.append(f"n{k + 1} AS (SELECT s, i, h, count(*) OVER (PARTITION BY s) AS n FROM u{k})")
    steps.append(f"r0 AS (SELECT s AS src, NULL::VARCHAR AS s, row_number() OVER (ORDER BY s IS NOT NULL, encode(s)) - 1 AS i, h, count(*) OVER () AS n FROM n{deep})")
    for k in range(over):
        steps.append(climb(f"r{k}", f"v{k}"))
        steps.append(f"r{k + 1} AS (SELECT s, i, h, count(*) OVER () AS n FROM v{k})")
    same = "a.s IS NOT DISTINCT FROM b.s"

    def walk(to: str, src: str, nodes: str, keep: str) -> list[str]:
        run = f"CASE WHEN b.n > 1 THEN a.i // {FANOUT} = b.i // {FANOUT} ELSE a.i = b.i END"
        return [
            f"""{to} AS (SELECT a.rid, any_value(a.s) AS s, CASE WHEN any_value(b.n) > 1 THEN any_value(a.i) // {FANOUT} ELSE any_value(a.i) END AS i, any_value(a.leaf) AS leaf,
            {keep} any_value(a.proof) || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i <> a.i), '') AS proof,
            CASE WHEN any_value(b.n) > 1 THEN sha256(string_agg(CASE WHEN b.i = a.i THEN a.now ELSE b.h END, '' ORDER BY b.i)) ELSE any_value(a.now) END AS now
            FROM {src} a JOIN {nodes} b ON {same} AND {run} GROUP BY a.rid)"""
        ]

    steps.append("w0 AS (SELECT rid, s, i, leaf, now, '' AS proof FROM t0)")
    for k in range(deep):
        steps += walk(f"w{k + 1}", f"w{k}", f"n{k}", "")
    steps.append(f"x0 AS (SELECT w.rid, NULL::VARCHAR AS s, r.i, w.leaf, r.h AS subroot, w.proof, w.now FROM w{deep} w JOIN r0 r ON w.s IS NOT DISTINCT FROM r.src)")
    for k in range(over):
        steps += walk(f"x{k + 1}", f"x{k}", f"r{k}", "any_value(a.subroot) AS subroot,")
    return (
        "WITH " + ", ".join(steps) + f"""
SELECT d.doc_id, x.leaf, x.subroot, (SELECT h FROM r{over}) AS root, sha256(x.proof) AS proof_sha256, x.now AS folded_root, x.now = (SELECT h FROM r{over}) AS verified
FROM x{over} x JOIN d ON d.rid = x.rid"""
    )


OP13_SQL = _sql()
