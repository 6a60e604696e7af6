"""N-gram Jaccard self-join by token-combination prefixes.

Texts are sets of 5-word shingles, the tokens. Texts ``x, y`` link when ``100 |x and y| >= 80 |x or y|``, so a link
leaves at most ``t = |x| - ceil(0.8 |x|)`` tokens of ``x`` unmatched. With all sets sorted in one order (the tokens'
hashes), the first ``t + m`` tokens of ``x`` hold at least ``m`` that the partner has among its own first tokens:

* *Extended prefixes.* ``m = 2 + t // 4``: a text with fewer than ``m`` prefix tokens that occur in another prefix has
  no partner and leaves; counts are taken again over those that stay, then over their whole sets, the longest
  prefix. Common passages in otherwise different texts end here.
* *Combinations.* Tokens of at most ``FREQUENT`` texts are rare and indexed alone. Frequent tokens fall into ``g``
  classes by their hash and are indexed in pairs of a class: if the first tokens of ``x`` hold ``n1`` others and
  ``n_i`` of class ``i`` with ``n1 + sum(max(0, n_i - 1)) >= t + 1``, a partner shares a rare token or two of a class.
  ``g = 1 + t // 4`` keeps that true of the extended prefix and the pairs in proportion to the prefix. Partners must
  use the same ``g``, so it comes from a band of sizes; sizes of a link lie in one band or two adjacent ones, and
  every text is indexed under its own band and the one below.
* *Verification* compares the whole sets.

Equal sets are one class from the start. A few rounds verify each class against one other outside its component,
that which comes first in most of its tokens, and join what links into components. Tokens within one component are then closed, texts with
fewer than ``m`` open tokens leave again, and the combination index is built over what is open. Keys with the same first
text form a neighbourhood, where only texts of different components are verified, in tiles of bounded size that give
pairs of components: large groups of near copies cost a few comparisons per text, texts beside such a group are compared
with its texts without a row per pair, and no link between components is lost. Only the narrow prefix tokens of all texts
are exchanged, packed by hash ranges; whole texts once, for those that stayed.

A null key has no component (null). Null and empty texts have no shingles and link with nothing. Rows with equal
keys are one node: they share a component. Extra columns are left out by :func:`near_duplicates` and pass through
:func:`keep_first`. Keys are 64-bit integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadloom.llm.common import SIMILARITY_PERCENT, columns_of, free_name, map_batches
from broadloom.llm.components import components
from broadloom.llm.shingles import shingle_set, word_hashes
from broadloom.session import discard, releasing_shuffles, stage

#: Texts up to which a token is rare.
FREQUENT = 64
#: Prefix tokens that a group of the counting exchange is planned to hold.
GROUP_TOKENS = 250_000
#: Tokens of a side of a tile in the last round.
TILE_TOKENS = 250_000
#: Rounds of leaving over open tokens; more rounds only save later work.
LEAVING_ROUNDS = 2
#: Rounds against one other text each, before all pairs between components; more rounds only save later work.
HUB_ROUNDS = 5


def allowed_misses(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens of a set of ``n`` that a partner may lack."""
    return n - -(-SIMILARITY_PERCENT * n // 100)


def sketched(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, n, print, prefix``: size, digest of the whole set, and its first tokens as packed integers."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, prints, prefixes = [], [], []
        for value in batch.column(1).to_pylist():
            tokens = shingle_set(word_hashes(value))
            n = len(tokens)
            t = allowed_misses(n)
            sizes.append(n)
            prints.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if n else None)
            prefixes.append(tokens[: t + 2 + t // 4].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(prefixes, pa.binary())], ["doc", "n", "print", "prefix"])

    return map_batches(documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")), sketch, "doc bigint, n bigint, print binary, prefix binary")


def repeated_texts(sets: DataFrame) -> DataFrame:
    """``doc, r`` of the whole sets of which all but the allowed misses, ``r`` tokens, are in other sets too."""
    whole = sets.select("doc", (F.length("tokens") / 8).cast("bigint").alias("n"), F.col("tokens").alias("prefix"))
    total = sets.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
    repeats = shared_tokens(whole, int(total) // GROUP_TOKENS + 1, counts_only=True)
    enough = whole.select("doc", "n").join(repeats, "doc").where(f"100 * r >= {SIMILARITY_PERCENT} * n")
    return enough.groupBy("doc").agg(F.max("r").alias("r"))


def shared_tokens(sketches: DataFrame, groups: int, counts_only: bool = False) -> DataFrame:
    """``doc, token, df, first``: the prefix tokens that more than one text has, with the smallest such text; or
    ``doc, r``: how many of them a text has.

    Tokens travel packed, by ranges of their hash. A batch with more than ``FREQUENT`` texts of a token sends the
    first of them with the count; the others are answered there and then with that text as their first.
    """
    shift = np.uint64(max(0, 64 - (groups - 1).bit_length()))
    groups = 1 << (64 - int(shift))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        tokens = [np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist()]
        token = np.concatenate(tokens)
        doc = np.repeat(np.array(batch.column(0), np.int64), [len(t) for t in tokens])
        if not len(token):
            return None
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        counts = np.diff(np.append(starts, len(token)))
        sizes = np.repeat(counts, counts)
        first = np.zeros(len(token), bool)
        first[starts] = True
        sent = first | (sizes <= FREQUENT)
        weight = np.where(sizes > FREQUENT, sizes, 1)[sent].astype(np.int32)
        part = (token >> shift).astype(np.int64) if groups > 1 else np.zeros(len(token), np.int64)
        cuts = np.searchsorted(part[sent], np.arange(groups + 1))
        rows = [(g, token[sent][a:b].tobytes(), doc[sent][a:b].tobytes(), weight[a:b].tobytes(), None) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        if not sent.all():
            # answered here; dealt by a hash of their own so that no group gets them all
            there = np.repeat(doc[starts], counts)[~sent]
            rest = (token[~sent], doc[~sent], sizes[~sent].astype(np.int32), there)
            cuts = np.append(np.arange(0, len(there), 10_000), len(there))
            rows += [(int(rest[1][a]) % groups, *(v[a:b].tobytes() for v in rest)) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(5)], ["part", "token", "doc", "weight", "first"])

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        answered, rest = [r for r in rows if r["first"] is not None], [r for r in rows if r["first"] is None]
        get = lambda rows, name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        token, doc, weight = get(rest, "token", np.uint64), get(rest, "doc", np.int64), get(rest, "weight", np.int32)
        order = np.lexsort((doc, token))
        token, doc, weight = token[order], doc[order], weight[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(token)))
        df = np.repeat(np.add.reduceat(weight, starts) if len(starts) else weight, counts)
        firsts = np.repeat(doc[starts], counts)
        more = df > 1
        columns = [
            np.concatenate([doc[more], get(answered, "doc", np.int64)]),
            np.concatenate([token[more], get(answered, "token", np.uint64)]).view(np.int64),
            np.concatenate([df[more], get(answered, "weight", np.int32)]).astype(np.int64),
            np.concatenate([firsts[more], get(answered, "first", np.int64)]),
        ]
        return pa.table(columns, ["doc", "token", "df", "first"])

    def tally(table: pa.Table) -> pa.Table:
        doc, k = np.unique(np.array(count(table).column("doc"), dtype=np.int64), return_counts=True)
        part = doc % groups
        order = np.argsort(part, kind="stable")
        doc, k, cuts = doc[order], k[order].astype(np.int64), np.searchsorted(part[order], np.arange(groups + 1))
        rows = [(g, doc[x:y].tobytes(), k[x:y].tobytes()) for g, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        return pa.table([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(3)], ["part", "doc", "k"])

    def add_up(table: pa.Table) -> pa.Table:
        doc, k = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("doc", "k"))
        docs, at = np.unique(doc, return_inverse=True)
        return pa.table([docs, np.bincount(at, k, len(docs)).astype(np.int64)], ["doc", "r"])

    packed = map_batches(sketches.where("doc is not null and n > 0").select("doc", "prefix"), pack, "part int, token binary, doc binary, weight binary, first binary")
    if counts_only:
        tallies = packed.groupBy("part").applyInArrow(tally, "part int, doc binary, k binary")
        return tallies.groupBy("part").applyInArrow(add_up, "doc bigint, r bigint")
    return packed.groupBy("part").applyInArrow(count, "doc bigint, token bigint, df bigint, first bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole sets link."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILARITY_PERCENT * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), check, "a bigint, b bigint")


#: What sizes and repeated tokens (``n, r`` and ``nb, rb``) allow: the common tokens are at most the smaller ``r``.
_ALLOWED = f"{100 + SIMILARITY_PERCENT} * least(r, rb) >= {SIMILARITY_PERCENT} * (n + nb)"


def hub_pairs(index: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """One candidate per text: of the texts in other components that come first in its tokens, in an order of the
    turn, the one that does so most often."""
    at = index.join(labels, index["doc"] == labels["node"], "left")
    at = at.select("doc", "n", "r", "token", F.coalesce("component", "doc").alias("c"))
    rank = F.struct((F.xxhash64("doc", F.lit(turn)) if turn else F.col("doc")).alias("rank"), "doc", "c", F.col("n").alias("nb"), F.col("r").alias("rb"))
    firsts = at.groupBy("token").agg(F.min(rank).alias("hub"))
    per = at.join(firsts, "token").select("doc", "n", "r", "c", "hub.nb", "hub.rb", F.col("hub.doc").alias("a"), F.col("hub.c").alias("ca"))
    per = per.where(f"c != ca and {_ALLOWED}").groupBy("doc", "a").agg(F.count("*").alias("k"))
    return per.groupBy(F.col("doc").alias("b")).agg(F.max(F.struct("k", "a"))["a"].alias("a")).select("a", "b")


def links(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc, n, cls`` of every row with a key, and ``node, component`` over classes that link with others.

    ``cls`` is the smallest key of the rows with the same set, the key itself for rows without shingles.
    """
    with releasing_shuffles(documents.sparkSession):
        return _links(documents, key, text)


def _links(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    sketches = stage(sketched(documents, key, text), "sketches")
    firsts = sketches.where("n > 0").groupBy("print").agg(F.min("doc").alias("cls"))
    classes = stage(
        sketches.select("doc", "n", "print").join(firsts, "print", "left").select("doc", "n", F.coalesce("cls", "doc").alias("cls")), "classes"
    )
    total = sketches.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    rows = shared_tokens(sketches, max(1, int(total) // GROUP_TOKENS + 1))
    # the classes' first texts stand for them, so copies do not count as other texts
    heads = classes.where("n > 0 and doc = cls").select("doc", "n").distinct()
    shared = stage(_stay(rows.select("doc", "token").join(heads, "doc")), "shared-tokens")
    counts = shared.groupBy("token").agg(F.count("*").alias("df"), F.min("doc").alias("first"))
    index = first_index = stage(_stay(shared.join(counts.where("df > 1"), "token")), "token-index")
    discard(sketches, shared)
    sizes = index.select("doc", "n").distinct()

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(word_hashes(v)).tobytes() for v in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc", "tokens"])

    texts = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    sets = all_sets = stage(map_batches(texts.join(sizes.select("doc"), "doc", "left_semi"), sets_of, "doc bigint, tokens binary"), "token-sets")

    enough = stage(repeated_texts(sets), "repeated-texts")
    index = index.drop("df", "first").join(enough, "doc")
    counts = index.groupBy("token").agg(F.count("*").alias("df"), F.min("doc").alias("first"))
    index = stage(_stay(index.join(counts.where("df > 1"), "token")), "token-index")
    sizes = index.select("doc", "n").distinct()
    sets = stage(sets.join(sizes.select("doc"), "doc", "left_semi"), "token-sets")
    discard(first_index, enough, all_sets)

    found, labels = None, sets.select(F.col("doc").alias("node"), F.col("doc").alias("component")).limit(0)
    for turn in range(HUB_ROUNDS):
        new = stage(verified(hub_pairs(index, labels, turn), sets), "links")
        if turn and new.isEmpty():
            break
        found = new if found is None else found.union(new)
        labels = components(found)
    more = cross_links(index, labels, sets)
    discard(index, sets)
    if not more.isEmpty():
        labels = components(found.union(more))
    return classes, labels


def _stay(index: DataFrame) -> DataFrame:
    """The rows of texts with enough tokens: a partner has ``least(n, t + 2 + t div 4) - t`` of them."""
    t = f"(n - ({SIMILARITY_PERCENT} * n + 99) div 100)"
    counted = index.withColumn("k", F.count("*").over(W.partitionBy("doc")))
    return counted.where(f"k >= least(n, {t} + 2 + {t} div 4) - {t}").drop("k")


def cross_links(index: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: components so far that link, found among texts that share a rare token or two frequent ones.

    Keys of the index with the same first text are one neighbourhood: the common tokens of a dense group have few first
    texts, so its texts stand in few neighbourhoods, however many keys they share. In a neighbourhood the texts outside
    its largest component are compared with all others, in tiles of at most about ``TILE_TOKENS`` tokens a side.
    """
    at = index.join(labels, index["doc"] == labels["node"], "left").select("doc", "n", "token", "df", F.coalesce("component", "doc").alias("c"))
    for _ in range(LEAVING_ROUNDS):
        at = stage(at, "labelled-index")
        spread = at.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
        at = _stay(at.join(spread, "token"))
    at = stage(at, "open-index")
    rare = at.where(F.col("df") <= FREQUENT).select(F.lit(-1).alias("band"), F.col("token").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "doc", "n", "c")
    band = F.floor(F.ln("n") / math.log(100 / SIMILARITY_PERCENT)).cast("int")
    often = at.where(F.col("df") > FREQUENT).select("doc", "n", "c", "token", F.explode(F.array(band, band - 1)).alias("band"))
    often = often.withColumn("least_n", F.floor(F.pow(F.lit(100 / SIMILARITY_PERCENT), F.col("band"))).cast("bigint"))
    often = often.withColumn("g", F.expr(f"pmod(token, 1 + (least_n - ({SIMILARITY_PERCENT} * least_n + 99) div 100) div 4)"))
    two = often.join(often.select("doc", "band", "g", F.col("token").alias("other")), ["doc", "band", "g"]).where("token < other")
    two = two.select("band", F.col("token").alias("k1"), F.col("other").alias("k2"), "doc", "n", "c")
    keyed = stage(rare.union(two), "combination-index")
    firsts = keyed.groupBy("band", "k1", "k2").agg(F.min("doc").alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    members = stage(keyed.join(firsts, ["band", "k1", "k2"]).select("hub", "doc", "n", "c").distinct(), "neighbourhoods")
    tiles = stage(_tiled(members), "tiles")
    groups = (tiles.agg(F.sum("n")).first()[0] or 0) // (2 * TILE_TOKENS) + 1
    group = F.pmod(F.xxhash64("hub", "p", "q"), F.lit(groups)).alias("group")
    held = tiles.join(sets, "doc").select(group, "hub", "p", "q", "side", "c", "tokens")
    found = stage(held.groupBy("group").applyInArrow(tile_links, "a bigint, b bigint").distinct(), "links")
    discard(keyed, members, tiles)
    return found


def _tiled(members: DataFrame) -> DataFrame:
    """``hub, p, q, side, doc, n, c`` of the neighbourhoods with several components: tile ``(p, q)`` compares its texts of
    side 0 with those of side 1, which are outside the neighbourhood's largest component."""
    per = members.groupBy("hub", "c").agg(F.sum("n").alias("m"))
    sizes = per.groupBy("hub").agg(F.count("*").alias("cs"), F.max(F.struct("m", "c")).alias("main"), F.sum("m").alias("all")).where("cs > 1")
    sizes = sizes.select("hub", F.col("main.c").alias("main"), F.expr(f"1 + main.m div {TILE_TOKENS}").alias("mains"), F.expr(f"1 + (all - main.m) div {TILE_TOKENS}").alias("others"))
    # parts 0 ... mains-1 are of the largest component, the rest of the others
    part = F.when(F.col("c") == F.col("main"), F.expr("pmod(xxhash64(doc), mains)")).otherwise(F.expr("mains + pmod(xxhash64(doc), others)"))
    at = members.join(sizes, "hub").withColumn("part", part)
    right = at.where("part >= mains").select("hub", F.explode(F.expr("sequence(0L, part)")).alias("p"), F.col("part").alias("q"), F.lit(1).alias("side"), "doc", "n", "c")
    left = at.select("hub", F.col("part").alias("p"), F.explode(F.expr("sequence(greatest(mains, part), mains + others - 1)")).alias("q"), F.lit(0).alias("side"), "doc", "n", "c")
    return left.union(right)


def tile_links(group: pa.Table) -> pa.Table:
    """Pairs of components that link in a group of tiles, each once: of every text of side 1 the common tokens with all
    texts of side 0 are counted at once."""
    found: set[tuple[int, int]] = set()
    where, side, c = (np.stack([group.column(n).to_numpy() for n in ("hub", "p", "q")]), group.column("side").to_numpy(), group.column("c").to_numpy())
    held = group.column("tokens").combine_chunks()
    order = np.lexsort((side, *where[::-1]))
    where, side, c = where[:, order], side[order], c[order]
    cuts = np.flatnonzero(np.concatenate([[True], (where[:, 1:] != where[:, :-1]).any(0), [True]]))
    for start, end in zip(cuts, cuts[1:]):
        tokens = [np.frombuffer(held[int(order[i])].as_buffer(), np.uint64) for i in range(start, end)]
        half = int(np.searchsorted(side[start:end], 1))
        if half in (0, end - start):
            continue
        left = np.concatenate(tokens[:half])
        sizes = np.array([len(t) for t in tokens])
        firsts = np.cumsum(sizes[:half]) - sizes[:half]
        known, ids = np.unique(left, return_inverse=True)
        marked = np.zeros(len(known) + 1, np.int64)
        for i in range(half, end - start):
            mine, n = int(c[start + i]), int(sizes[i])
            open_ = (c[start : start + half] != mine) & (100 * sizes[:half] >= SIMILARITY_PERCENT * n) & (100 * n >= SIMILARITY_PERCENT * sizes[:half])
            if not open_.any():
                continue
            at = np.searchsorted(known, tokens[i])
            at[known[np.minimum(at, len(known) - 1)] != tokens[i]] = len(known)
            marked[at] = 1
            marked[-1] = 0
            both = np.add.reduceat(marked[ids], firsts)
            marked[at] = 0
            ok = open_ & (100 * both >= SIMILARITY_PERCENT * (sizes[:half] + n - both))
            found.update((min(mine, o), max(mine, o)) for o in np.unique(c[start : start + half][ok]).tolist())
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pa.table([pairs[:, 0], pairs[:, 1]], ["a", "b"])


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` per row: the columns of query ``op6_ngram_join``."""
    classes, labels = links(documents, key, text)
    out = classes.join(labels, classes["cls"] == labels["node"], "left")
    kind = documents.schema[key].dataType.simpleString()
    return out.select(F.col("doc").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "cls").alias("component_id"))


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose key is the smallest of their component, with the columns they had; rows without a key stay."""
    found = near_duplicates(documents, key, text)
    name = free_name(documents, "_first")
    firsts = found.where(F.col(key).cast("bigint") == F.col("component_id")).select(F.col(key).alias(name)).distinct()
    kept = documents.where(F.col(key).isNotNull()).join(firsts, F.col(key) == F.col(name), "left_semi").select(*columns_of(documents))
    return kept.union(documents.where(F.col(key).isNull()))


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY ALL
"""
