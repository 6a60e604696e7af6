"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard. At each node every child draws ``-ln(u) / weight``
with ``u`` a hash of the row's key and the child's name, and the smallest draw wins (ties: the smaller name), so a
child is chosen in proportion to its weight and its draw depends on nothing but its own name and weight. When a
weight changes, only draws of the subtrees on the way to it change: rows move into (or out of) those subtrees and
nowhere else. A shard added as a region of its own takes rows only into itself.

Everything is column expressions; rows are placed in the scan. Slots count the rows of a shard from 0 without gaps:
rows are numbered in blocks of a shard (a hash of key and text, about ``BLOCK_ROWS`` rows each) behind the sizes of the
blocks before, so no task ever holds a whole shard, nor all rows of a key or of the null key.

Null keys are a key of their own (``'null'``), null texts have no bytes and checksum 0. Repeated rows share the
shard and get slots of their own. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadloom.llm.common import utf8, whole_text

#: Rows that a block of a shard is planned to have, and bytes of a row besides its text.
BLOCK_ROWS = 10_000
ROW_BYTES = 8
#: Hexadecimal digits of the hash that make ``u``.
_DIGITS = 13


@dataclass(frozen=True)
class Node:
    """A node of the tree; a leaf has a shard number and a weight of its own, others weigh what they hold."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def even_tree(regions: int, racks: int, shards: int) -> Node:
    """A tree of equal weights whose shards count up from 0."""
    n = iter(range(regions * racks * shards))
    return Node(
        "",
        tuple(
            Node(f"r{r}", tuple(Node(f"r{r}/k{k}", tuple(Node(f"r{r}/k{k}/s{s}", shard=s) for s in (next(n) for _ in range(shards)))) for k in range(racks)))
            for r in range(regions)
        ),
    )


def with_region(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more region that holds one more shard."""
    name = f"r{len(tree.children)}"
    leaf = Node(f"{name}/k0/s{shard}", shard=shard, leaf_weight=weight)
    return Node(tree.name, (*tree.children, Node(name, (Node(f"{name}/k0", (leaf,)),))))


def draw(key: Column, node: Node) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", key, F.lit(node.name)).cast("binary")), 1, _DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return -F.ln(u) / F.lit(float(node.weight))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard number of a string key: a draw for each child on the way down, none off it."""
    if not tree.children:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return shard_of(key, tree.children[0])
    best = F.array_min(F.array(*(F.struct(draw(key, c).alias("draw"), F.lit(i).alias("at")) for i, c in enumerate(tree.children))))["at"]
    if all(not c.children for c in tree.children):
        return F.element_at(F.array(*(F.lit(c.shard) for c in tree.children)), best + 1)
    # the index is bound once, as the one element of an array, not repeated in each branch
    return F.transform(F.array(best), lambda at: _branch(key, tree, at))[0]


def _branch(key: Column, tree: Node, at: Column) -> Column:
    out = F.when(at == 0, shard_of(key, tree.children[0]))
    for i, child in enumerate(tree.children[1:], 1):
        out = out.when(at == i, shard_of(key, child))
    return out


def place(df: DataFrame, tree: Node, key: str = "doc_id", text: str = "text", grown: Node | None = None) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` per row.

    ``grown_shard`` is the shard under ``grown``, null without it.
    """
    block_rows = BLOCK_ROWS * _leaves(tree)
    blocks = -(-df.count() // block_rows) or 1
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    placed = df.select(
        F.col(key),
        (F.octet_length(whole_text(df, text)).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(utf8(whole_text(df, text))).alias("text_crc32"),
        shard_of(name, tree).cast("int").alias("shard"),
        (shard_of(name, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    spread = F.md5(F.concat_ws("|", name, "text_crc32", "size").cast("binary"))
    placed = placed.withColumn("block", F.pmod(F.conv(F.substring(spread, 25, 8), 16, 10).cast("bigint"), F.lit(blocks)))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("at", F.row_number().over(W.partitionBy("shard", "block").orderBy(key, "text_crc32", "size")) - 1)
    return numbered.join(before, ["shard", "block"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at")).cast("bigint").alias("slot"), "grown_shard"
    )


def _leaves(tree: Node) -> int:
    return sum(map(_leaves, tree.children)) if tree.children else 1


#: The tree of query ``op8_sharding``: shards 0 to 23, and shard 24 as the region that grows.
TREE = even_tree(2, 3, 4)
GROWN = with_region(TREE, 24)


def _draws_sql() -> str:
    """A row for each node below the root: name, parent, shard, weight and whether only the grown tree has it."""
    rows = []

    def walk(node: Node, parent: str | None, old: bool) -> None:
        if parent is not None:
            rows.append(f"('{node.name}', '{parent}', {node.shard}, {float(node.weight)}, {old})")
        for c in node.children:
            walk(c, node.name, old and (parent is not None or c.name in {x.name for x in TREE.children}))

    walk(GROWN, None, True)
    return ", ".join(rows)


SQL = f"""
WITH node(name, parent, shard, weight, old) AS (VALUES {_draws_sql()}),
crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
bytes AS (
    SELECT doc_id, key, octet_length(encode(text)) + 8 AS size,
        list_transform(regexp_extract_all(hex(encode(text)), '..'),
            lambda x: CAST((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1 AS BIGINT)) AS b FROM d),
base AS (
    SELECT doc_id, key, CAST(size AS BIGINT) AS size,
        CAST(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
    FROM bytes, crc_table),
draws AS (
    SELECT key, name, parent, shard, old,
        -ln((CAST('0x' || substr(md5(key || '|' || name), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS draw
    FROM (SELECT DISTINCT key FROM d), node),
best AS (
    SELECT key, parent, arg_min(name, (draw, name)) AS grown, arg_min(name, (draw, name)) FILTER (old) AS name FROM draws GROUP BY key, parent),
old AS (
    SELECT a.key, n.shard FROM best a JOIN best b ON b.key = a.key AND b.parent = a.name JOIN best c ON c.key = b.key AND c.parent = b.name
    JOIN node n ON n.name = c.name WHERE a.parent = ''),
new AS (
    SELECT a.key, n.shard FROM best a JOIN best b ON b.key = a.key AND b.parent = a.grown JOIN best c ON c.key = b.key AND c.parent = b.grown
    JOIN node n ON n.name = c.grown WHERE a.parent = ''),
blocks AS (SELECT greatest(1, CAST(ceil(count(*) / {BLOCK_ROWS * 24}.0) AS BIGINT)) AS n FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(old.shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY old.shard ORDER BY CAST('0x' || substr(md5(base.key || '|' || text_crc32 || '|' || size), 25, 8) AS BIGINT) % blocks.n, doc_id, text_crc32, size) - 1 AS slot,
    CAST(new.shard AS INTEGER) AS grown_shard
FROM base JOIN old USING (key) JOIN new USING (key), blocks
"""
