"""SimHash near-duplicates: 64-bit fingerprints that differ in at most ``DIFFERENCES`` bits link, and links make components.

A fingerprint bit is set if it is set in more than half of the hashes of a text's shingles, repeats included.

*Pigeonring filtering.* The 64 bits are cut into ``DIFFERENCES + 1`` segments, taken as a ring. If two fingerprints differ
in at most ``t`` bits, then from some segment on every chain of ``1, 2, …`` consecutive segments stays within its share of
the budget: ``l`` segments differ in at most ``floor(l t / (t + 1)) = l - 1`` bits. So a link has a segment that is equal
and whose successor differs in one bit at most: these two segments are the index. The side that has the differing bit set
clears it, so every fingerprint is indexed as it is, and once for each set bit of the successor; an equal key then means a
viable chain of two. Longer chains are tested before the full Hamming distance.

*Groups.* Equal fingerprints are one from the start. In each key, all members are first compared with two of them, the
smallest and the largest, which joins dense groups into components in linear work. Only keys that still hold several
components go on: there the members outside the key's largest component are compared with all others, in tiles of
at most ``TILE`` members a side, so that no task holds a whole hot key, and what comes out are pairs of components,
not of texts. No link between components is lost.

*Joins.* Both sides of every join here grow with the texts, and Spark sizes them too low: an explode counts as its input, and
stages of sorted keys are small as files only. So none is ever broadcast (:func:`sorted_join`).

Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than ``SHINGLE`` words is one shingle,
null and empty texts have fingerprint zero, which links like any other. Texts are hashed whole, batch by batch. A null key
has a fingerprint, and the component of the fingerprints it links with; without another key there it is null. Rows with
equal keys are one node only if their fingerprints link. Extra columns are left out by :func:`near_duplicates`.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.common import map_batches, sorted_join
from broadloom.llm.components import components
from broadloom.session import discard, releasing_shuffles, stage

DIFFERENCES = 4
SHINGLE = 4
SEED = 42
#: Members a side that a tile of a key is planned to hold, and rows of a group of small keys.
TILE = 2048
GROUP_ROWS = 20_000
#: Pairs that are compared at once.
PAIRS = 1 << 22

#: First bit and width of each segment, from the lowest bit; one more segments than differences.
SEGMENTS = [(64 * i // (DIFFERENCES + 1), 64 * (i + 1) // (DIFFERENCES + 1) - 64 * i // (DIFFERENCES + 1)) for i in range(DIFFERENCES + 1)]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def chain_mask(start: int, length: int) -> int:
    """The bits of ``length`` segments of the ring from ``start`` on."""
    out = 0
    for k in range(length):
        first, width = SEGMENTS[(start + k) % len(SEGMENTS)]
        out |= ((1 << width) - 1) << first
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each run of ``SHINGLE`` words joined by a blank, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0, *(e + 1 for e in ends[:-SHINGLE])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a text's hashes, as a signed integer: bits are counted by the values of each byte."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 64:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, print`` of every row; the print is the fingerprint as a signed integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc", "print"])

    kind = documents.schema[key].dataType.simpleString()
    return map_batches(documents.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")), run, f"doc {kind}, print bigint")


def _part(print_: Column, start: int) -> Column:
    """A segment of the ring as a number."""
    first, width = SEGMENTS[start % len(SEGMENTS)]
    return F.shiftrightunsigned(print_, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _keys(start: int) -> Column:
    """``(k, own)`` of the print for the chain from ``start``: its own key, and one for each set bit of the successor."""
    width = SEGMENTS[(start + 1) % len(SEGMENTS)][1]
    head, tail = F.shiftleft(_part(F.col("print"), start), width), _part(F.col("print"), start + 1)
    key = lambda low, own: F.struct((F.shiftleft(head + low, 3) + start).alias("k"), F.lit(own).alias("own"))
    cleared = [F.when(F.shiftright(tail, i) % 2 == 1, key(tail - (1 << i), False)) for i in range(width)]
    return F.array(key(tail, True), *cleared)


def indexed(prints: DataFrame) -> DataFrame:
    """``k, print, own``: every key of every print; ``own`` where no bit was cleared."""
    keys = F.concat(*[_keys(start) for start in range(len(SEGMENTS))])
    return prints.select("print", F.explode(keys).alias("e")).where("e is not null").select(F.col("e.k").alias("k"), "print", F.col("e.own").alias("own"))


def linked(a: str, b: str) -> str:
    """SQL text: both differ in few enough bits and the chain from the key's segment stays within its budgets."""
    tests = [f"bit_count({a} ^ {b}) <= {DIFFERENCES}"]
    for length in range(3, DIFFERENCES + 1):
        masks = ", ".join(f"{_signed(chain_mask(s, length))}L" for s in range(len(SEGMENTS)))
        tests.insert(-1, f"bit_count(({a} ^ {b}) & element_at(array({masks}), CAST(k & 7 AS INT) + 1)) <= {length - 1}")
    return " AND ".join(tests)


def hub_links(members: DataFrame) -> DataFrame:
    """``a, b``: each member of an open key with the key's smallest and largest own print, where they link."""
    hubs = members.select("k", "print", F.explode(F.array("lo", "hi")).alias("hub")).where("print != hub")
    return hubs.where(linked("print", "hub")).select(F.col("print").alias("a"), F.col("hub").alias("b"))


def _tiled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``k, p, q, print, own, c, side`` of the keys that hold several components: tile ``(p, q)`` compares its rows of
    side 0 with those of side 1, side 1 being outside the key's largest component."""
    at = sorted_join(members.select("k", "print", "own"), labels, members["print"] == labels["node"], "left")
    at = at.select("k", "print", "own", F.coalesce("component", "print").alias("c"))
    per = at.groupBy("k", "c").agg(F.count("*").alias("m"))
    sizes = per.groupBy("k").agg(F.count("*").alias("cs"), F.max(F.struct("m", "c")).alias("main"), F.sum("m").alias("n")).where("cs > 1")
    sizes = sizes.select("k", F.col("main.c").alias("main"), F.expr(f"1 + (main.m - 1) div {TILE}").alias("mains"), F.expr(f"1 + (n - main.m - 1) div {TILE}").alias("others"))
    at = sorted_join(at, sizes, "k")
    # parts 0 … mains-1 are of the largest component, the rest of the others
    of_main = F.expr("pmod(xxhash64(print), mains)")
    of_rest = F.expr("mains + pmod(xxhash64(print), others)")
    part = F.when(F.col("c") == F.col("main"), of_main).otherwise(of_rest)
    at = at.withColumn("part", part)
    right = at.where("part >= mains").select("k", F.explode(F.expr("sequence(0L, part)")).alias("p"), F.col("part").alias("q"), "print", "own", "c", F.lit(1).alias("side"))
    left = at.select("k", F.col("part").alias("p"), F.explode(F.expr("sequence(greatest(mains, part), mains + others - 1)")).alias("q"), "print", "own", "c", F.lit(0).alias("side"))
    return left.union(right)


def tile_links(group: pa.Table) -> pa.Table:
    """Pairs of components that link in a group of tiles, each once; pairs are compared ``PAIRS`` at a time."""
    k, p, q, print_, c, side = (group.column(n).to_numpy() for n in ("k", "p", "q", "print", "c", "side"))
    own = group.column("own").to_numpy()
    order = np.lexsort((side, q, p, k))
    k, p, q, print_, c, side, own = (v[order] for v in (k, p, q, print_, c, side, own))
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
    sizes = np.diff(np.append(new, len(k)))
    rights = np.add.reduceat(side, new)
    lefts = sizes - rights
    found = [np.zeros((0, 2), np.int64)]
    done = np.cumsum(lefts * rights)
    cuts = np.unique(np.append(np.searchsorted(done, np.arange(0, done[-1], PAIRS)), len(new)))
    for g, h in zip(cuts, cuts[1:]):
        # each left row beside all right rows of its tile
        per_left = np.repeat(rights[g:h], lefts[g:h])
        left = np.repeat(np.repeat(new[g:h], lefts[g:h]) + _counted(lefts[g:h]), per_left)
        right = np.repeat(np.repeat(new[g:h] + lefts[g:h], lefts[g:h]), per_left) + _counted(per_left)
        diff = (print_[left] ^ print_[right]).view(np.uint64)
        ok = (c[left] != c[right]) & (own[left] | own[right])
        for length in range(3, DIFFERENCES + 2):
            masks = np.array([chain_mask(s, length) for s in range(len(SEGMENTS))], np.uint64)
            ok &= np.bitwise_count(diff & masks[k[left] & 7]) < length
        x, y = c[left[ok]], c[right[ok]]
        found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table([pairs[:, 0], pairs[:, 1]], ["a", "b"])


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 … n-1 for each size n, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def open_keys(prints: DataFrame) -> DataFrame:
    """``k, print, own, lo, hi``: the keys that may link prints, with the smallest and largest own print."""
    rows = indexed(prints)
    # a key without an own print, or with one print only, links nothing
    open_ = rows.groupBy("k").agg(F.min(F.when(F.col("own"), F.col("print"))).alias("lo"), F.max(F.when(F.col("own"), F.col("print"))).alias("hi"), F.count("*").alias("n"))
    return sorted_join(rows, open_.where("n > 1 and lo is not null").drop("n"), "k")


def print_components(prints: DataFrame) -> DataFrame:
    """``node, component`` over the distinct prints that link with others; the component is one of its prints."""
    members = stage(open_keys(prints), "open-keys")
    near = stage(hub_links(members).distinct(), "hub-links")
    labels = components(near)
    tiles = stage(_tiled(members, labels), "tiles")
    groups = -(-tiles.count() // GROUP_ROWS) or 1
    group = F.pmod(F.xxhash64("k", "p", "q"), F.lit(groups)).alias("g")
    more = stage(tiles.select("*", group).groupBy("g").applyInArrow(tile_links, "a bigint, b bigint").distinct(), "tile-links")
    discard(members, tiles)
    return labels if more.isEmpty() else components(near.union(more))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id`` per row: the columns of query ``op12_simhash``."""
    with releasing_shuffles(documents.sparkSession):
        docs = stage(fingerprints(documents, key, text), "fingerprints")
        prints = stage(docs.groupBy("print").agg(F.min("doc").alias("first")), "prints")
        labels = print_components(prints.select("print"))
        named = sorted_join(prints, labels, prints["print"] == labels["node"], "left").select("print", "first", F.coalesce("component", "print").alias("c"))
        lowest = named.groupBy("c").agg(F.min("first").alias("component_id"))
        named = stage(sorted_join(named, lowest, "c").select(F.col("print").alias("of"), "component_id"), "print-components")
    out = sorted_join(docs, named, docs["print"] == named["of"])
    return out.select(F.col("doc").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose key is the smallest of their component, with the columns they had; rows without a key stay."""
    found = near_duplicates(documents, key, text)
    firsts = found.where(F.col(f"`{key}`") == F.col("component_id")).select(F.col(f"`{key}`").alias("__first")).distinct()
    kept = documents.join(firsts, documents[key] == firsts["__first"], "left_semi")
    return kept.union(documents.where(documents[key].isNull()))
