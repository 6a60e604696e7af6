"""Merkle manifest of a dataset: a root digest, and for every row a proof that it belongs to it.

Rows are leaves of one tree per value of a column (null is a value), trees are leaves of one tree over all. Nodes that
stand side by side are hashed in runs of three (the last run may be shorter, even one) until one node remains; a tree
of one leaf is that leaf. A node's digest is the SHA-256 of the digests of its run, as lower-case hex text.

*Cogrouped subtree exchange.* Leaves are numbered within their tree by a range partition, counts per partition and
prefix sums, so that no task holds a tree. ``BLOCK`` consecutive leaves, a power of three, form a superblock, the unit
of all grouped work; a tree larger than that is cut into superblocks, smaller trees share units by a hash. Upwards,
a superblock is reduced to one node; the nodes of all superblocks of a tree are the leaves of the next step. Downwards, a
superblock's nodes are cogrouped with the one row of outer nodes that its proofs need, the siblings above it, and one
call finishes the local reduction, joins each leaf's siblings inside to those outside, and folds the leaf that is to be
tested up to the root. Only narrow rows travel: key, tree and digests, never the hashed columns.

Nulls in hashed columns are hashed as ``-``, other values as their UTF-8 length, ``:`` and the value, so that null,
empty and ``-`` differ. A null key sorts first and is hashed like any null; rows with equal keys are ordered by their leaf,
and rows equal in both are interchangeable. Extra columns are left out, also those with the names that results use. Very
long texts are hashed whole, where they are read. An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadloom.session import stage

#: Nodes of a run, and leaves of a superblock: a power of it.
RUN = 3
BLOCK = RUN**7
#: Rows that a partition is planned to put in order, and the most partitions to plan; beyond, they hold more.
PART_ROWS = 20_000
MOST_PARTS = 50_000


def joined_digest(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and the path of its proof give: ``before|after`` per level, the digests of its run."""
    for step in path.split(";") if path else ():
        before, after = step.split("|")
        leaf = joined_digest((before, leaf, after))
    return leaf


def leaf_digest(values: Sequence[Column]) -> Column:
    """The leaf of a row with these values, integers in decimal."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def levels(nodes: list[str], alone: bool, block: int = BLOCK) -> list[list[str]]:
    """The node levels over a superblock, itself first: until one node remains, or as high as a superblock is."""
    out = [nodes]
    height = 0
    while len(out[-1]) > 1 if alone else RUN**height < block:
        below = out[-1]
        out.append([joined_digest(below[i : i + RUN]) for i in range(0, len(below), RUN)])
        height += 1
    return out


def paths(nodes: list[str], alone: bool, outer: str, block: int = BLOCK) -> list[str]:
    """The path of each node of a superblock: inside it, then ``outer``."""
    tree = levels(nodes, alone, block)
    found = [outer]
    for level in reversed(tree[:-1]):
        steps = []
        for i in range(len(level)):
            first = i - i % RUN
            step = f"{''.join(level[first:i])}|{''.join(level[i + 1 : first + RUN])}"
            above = found[i // RUN]
            steps.append(f"{step};{above}" if above else step)
        found = steps
    return found


def _in_units(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes ``tree, pos, n, …`` with their superblock and the unit (``of``, ``unit``) that it is worked in."""
    total = nodes.count()
    own = F.col("n") > block
    return nodes.select(
        "*",
        F.expr(f"pos div {block}").alias("block"),
        F.when(own, F.col("tree")).otherwise(F.lit("")).alias("of"),
        F.when(own, F.expr(f"pos div {block}")).otherwise(F.pmod(F.xxhash64("tree"), F.lit(-(-total // block) or 1))).alias("unit"),
    )


def _superblocks(unit: pd.DataFrame) -> Iterator[tuple[str, int, pd.DataFrame]]:
    for (tree, block), rows in unit.groupby(["tree", "block"], sort=False):
        yield tree, block, rows.sort_values("pos", kind="stable")


def _reduce(unit: pd.DataFrame, size: int) -> pd.DataFrame:
    out = []
    for tree, block, rows in _superblocks(unit):
        n = int(rows["n"].iloc[0])
        out.append((tree, block, -(-n // size), levels(rows["digest"].tolist(), n <= size, size)[-1][0]))
    return pd.DataFrame(out, columns=["tree", "pos", "n", "digest"])


def _descend(unit: pd.DataFrame, outer: pd.DataFrame, size: int) -> pd.DataFrame:
    above = {(t, b): p for t, b, p in zip(outer["tree"], outer["block"], outer["path"])}
    out = []
    for tree, block, rows in _superblocks(unit):
        found = paths(rows["digest"].tolist(), int(rows["n"].iloc[0]) <= size, above[tree, block], size)
        out += [(tree, p, path) for p, path in zip(rows["pos"], found)]
    return pd.DataFrame(out, columns=["tree", "pos", "path"])


def _finish(unit: pd.DataFrame, outer: pd.DataFrame, size: int) -> pd.DataFrame:
    """Leaves meet the outer nodes of their superblock: local reduction, proofs and folding in one call."""
    above = {(t, b): (p, s) for t, b, p, s in zip(outer["tree"], outer["block"], outer["path"], outer["subroot"])}
    parts = []
    for tree, block, rows in _superblocks(unit):
        path, subroot = above[tree, block]
        found = paths(rows["digest"].tolist(), int(rows["n"].iloc[0]) <= size, path, size)
        tested = rows["tested"].where(rows["tested"].notna(), rows["digest"])
        folded = [fold(leaf, p) for leaf, p in zip(tested, found)]
        parts.append(pd.DataFrame({"key": rows["key"], "tree": tree, "leaf": rows["digest"], "subroot": subroot, "path": found, "folded_root": folded}))
    return pd.concat(parts, ignore_index=True)


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Staged rows with ``pos``, the place in their tree by ``order`` from 0, and ``n``, the rows of the tree.

    One range exchange; what partitions hold of a tree is counted and summed up, so a tree may span many of them.
    """
    parts = min(-(-rows.count() // PART_ROWS) or 1, MOST_PARTS)
    placed = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    placed = stage(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ordered")
    held = placed.groupBy(tree, "_part").agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    of_tree = W.partitionBy(tree)
    before = F.sum("_k").over(of_tree.orderBy("_part")) - F.col("_k")
    held = held.select(tree, "_part", "_first", before.alias("_before"), F.sum("_k").over(of_tree).alias("n"))
    pos = F.col("_before") + F.col("_at") - F.col("_first")
    return placed.join(held, [tree, "_part"]).select(*rows.columns, pos.alias("pos"), "n")


def _reduced(leaves: DataFrame, block: int) -> list[DataFrame]:
    """The node tables over ``tree, pos, n, digest`` in units, from the leaves to one node per tree."""
    tables = [_in_units(leaves, block)]
    while True:
        nodes = tables[-1].select("tree", "pos", "n", "digest", "block", "of", "unit")
        above = nodes.groupBy("of", "unit").applyInPandas(lambda unit: _reduce(unit, block), "tree string, pos bigint, n bigint, digest string")
        tables.append(_in_units(stage(above, "nodes"), block))
        if tables[-1].where("n > 1").isEmpty():
            return tables


def manifest(df: DataFrame, columns: Sequence[str], key: str = "doc_id", tree: str = "source", tested: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``key, tree, leaf, subroot, root, path, folded_root`` per row of ``df``.

    ``columns`` are hashed in their order. ``path`` is the proof, for :func:`fold`. ``tested`` is the leaf digest
    that stands in a later copy of the row and is folded instead of the row's own, null for the own one. ``block``, the
    leaves of a superblock, is a power of ``RUN``; results do not depend on it.
    ``folded_root`` equals ``root`` exactly if the tested leaf is the row's.
    """
    # null before every other tree: the empty string sorts before any name behind a sign
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{tree}`").cast("string")), F.lit(""))
    leaves = df.select(
        F.col(f"`{key}`").alias("key"),
        name.alias("tree"),
        leaf_digest([F.col(f"`{c}`") for c in columns]).alias("digest"),
        (tested if tested is not None else F.lit(None)).cast("string").alias("tested"),
    )
    leaves = stage(leaves, "leaves")
    return _manifest(leaves, df.schema[tree].dataType.simpleString(), key, tree, block)


def _manifest(leaves: DataFrame, kind: str, key: str, tree: str, block: int) -> DataFrame:
    spark, key_kind = leaves.sparkSession, leaves.schema["key"].dataType.simpleString()
    ordered = stage(numbered(leaves, "tree", ["key", "digest"]), "numbered")
    steps = _reduced(ordered, block)
    subroots = steps[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = stage(numbered(subroots, "tree", ["name"]), "subroots")
    over = _reduced(top, block)
    root = over[-1].select("digest").first()
    if root is None:  # no rows at all
        return spark.createDataFrame([], f"`{key}` {key_kind}, `{tree}` {kind}, leaf string, subroot string, root string, path string, folded_root string")
    found = over[-1].select("tree", F.col("pos").alias("block"), F.lit("").alias("path"))
    for nodes in reversed(over[:-1]):
        found = _paths_of(nodes, found, block)
    names = top.select(F.col("pos").alias("_at"), "name", F.col("digest").alias("subroot"))
    found = found.join(names, found["block"] == names["_at"]).select(F.col("name").alias("tree"), "subroot", F.lit(0).cast("bigint").alias("block"), "path")
    found = stage(found, "outer")
    tops = found.select("tree", "subroot")
    for nodes in reversed(steps[1:-1]):
        found = _paths_of(nodes, found, block)
    if len(steps) > 2:
        found = found.join(tops, "tree")
    # keys travel as text: pandas would turn integers beside nulls into doubles
    lower = steps[0].select(F.col("key").cast("string").alias("key"), "tree", "pos", "n", "digest", "tested", "block", "of", "unit")
    schema = "key string, tree string, leaf string, subroot string, path string, folded_root string"
    finished = lower.groupBy("of", "unit").cogroup(_for_units(found, lower).groupBy("for_of", "for_unit")).applyInPandas(lambda unit, above: _finish(unit, above, block), schema)
    named = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).cast(kind)
    return finished.select(F.col("key").cast(key_kind).alias(key), named.alias(tree), "leaf", "subroot", F.lit(root["digest"]).alias("root"), "path", "folded_root")


def _for_units(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The outer row of each superblock of ``nodes``, beside its unit."""
    units = nodes.groupBy(F.col("tree").alias("_t"), F.col("block").alias("_b")).agg(F.max("of").alias("for_of"), F.max("unit").alias("for_unit"))
    return found.join(units, (found["tree"] == units["_t"]) & (found["block"] == units["_b"])).drop("_t", "_b")


def _paths_of(nodes: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """Outer rows ``tree, block, path`` of the superblocks below ``nodes``, each of which is one of these superblocks."""
    lower = nodes.select("tree", "pos", "n", "digest", "block", "of", "unit")
    outer = _for_units(found.select("tree", "block", "path"), lower)
    out = lower.groupBy("of", "unit").cogroup(outer.groupBy("for_of", "for_unit")).applyInPandas(lambda unit, above: _descend(unit, above, block), "tree string, pos bigint, path string")
    return stage(out.select("tree", F.col("pos").alias("block"), "path"), "outer")


#: The columns that a leaf of ``documents`` hashes.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def document_proofs(documents: DataFrame) -> DataFrame:
    """The columns of query ``op11_merkle``: every document with its proof, and what a copy folds to that lost its line breaks
    where 2 divides the checksum of the key; a null key is never tampered with."""
    text = F.translate("text", "\n", "")
    changed = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0) & F.col("text").contains("\n")
    tampered = F.when(changed, leaf_digest([F.col(c) if c != "text" else text for c in LEAF]))
    out = manifest(documents, LEAF, tested=tampered)
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.translate("path", "|;", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _leaf_sql(text: str) -> str:
    parts = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF]
    return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({p})) AS VARCHAR) || ':' || {p}, '-')" for p in parts) + ")"


SQL = rf"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
    SELECT *, {_leaf_sql("text")} AS leaf,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
    FROM documents, crc_table),
leaves AS (
    SELECT doc_id, leaf, coalesce('+' || source, '') AS tree,
        CASE WHEN crc % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE leaf END AS tested,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n
    FROM d),
up AS (
    SELECT tree, 0 AS level, pos, n, leaf AS h FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 3, CAST(ceil(any_value(n) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY pos))
    FROM up WHERE n > 1 GROUP BY tree, level, pos // 3),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
    SELECT 0 AS level, pos, n, subroot AS h FROM sub
    UNION ALL
    SELECT level + 1, pos // 3, CAST(ceil(any_value(n) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY pos))
    FROM over WHERE n > 1 GROUP BY level, pos // 3),
inner_steps AS (
    SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS pre,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS post
    FROM up a JOIN up b ON b.tree = a.tree AND b.level = a.level AND b.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY ALL),
outer_steps AS (
    SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS pre,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS post
    FROM over a JOIN over b ON b.level = a.level AND b.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY ALL),
climb AS (
    SELECT tree, pos AS id, 0 AS level, pos AS spot, tested AS h, '' AS proof FROM leaves
    UNION ALL
    SELECT c.tree, id, c.level + 1, spot // 3, sha256(pre || h || post), proof || pre || post
    FROM climb c JOIN inner_steps s ON s.tree = c.tree AND s.level = c.level AND s.pos = c.spot),
climbed AS (SELECT tree, id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY tree, id),
finish AS (
    SELECT tree, id, 0 AS level, sub.pos AS spot, h, proof FROM climbed JOIN sub USING (tree)
    UNION ALL
    SELECT f.tree, id, f.level + 1, spot // 3, sha256(pre || h || post), proof || pre || post
    FROM finish f JOIN outer_steps s ON s.level = f.level AND s.pos = f.spot),
finished AS (SELECT tree, id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM finish GROUP BY tree, id),
root AS (SELECT h AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN sub USING (tree) JOIN finished f ON f.tree = l.tree AND f.id = l.pos, root
"""
