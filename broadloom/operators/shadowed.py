"""Forests of a selection's runs grown together over stored shadow blocks: one pass over the rows per level, for all trees of all runs.

Rows are dealt by block, put in hash order, binned once and kept, a string of bytes per block and column. A pass makes the
shadows of a run by rotating these strings, follows the rows of each tree's bag to its open nodes and sums the nodes' histograms;
they are added by tree, which also picks the splits. Only splits and importances come to the driver. Splits, columns per node,
bags and pruning are those of :mod:`broadloom.operators.grown`; a row's bag is drawn from its block and place, so it depends on no partition.

A pass holds histograms of ``PASS_BYTES`` a task, wider forests take several; a task holds ``CHUNK_ROWS`` rows and its partition's bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from broadloom.functions import cells
from broadloom.operators import grown, permutation
from broadloom.operators.selectors import col
from broadloom.operators.shadows import BLOCK, block_count, offset_draw, shadow_name

PASS_BYTES = 64 << 20
CHUNK_ROWS, CHUNK_BYTES = 1 << 18, 32 << 20
PARTITION_BYTES = 64 << 20


@dataclass
class Blocks:
    """Packed blocks: ``part, __block`` and bytes per label and field, kept until ``unpersist()``."""

    packed: DataFrame
    labels: dict[str, str]
    fields: dict[str, str]
    #: Labels that are 0 or 1 in all rows, and the largest value of labels that are whole numbers.
    flags: dict[str, bool]
    most: dict[str, int | None]

    def unpersist(self) -> None:
        self.packed.unpersist()


def blocks(staged: DataFrame, key: str, labels: Sequence[str], fields: Sequence[str], seed: int, bins: int, rows_per_block: int) -> Blocks:
    """The rows of a stage with unique keys, packed; labels and fields must be numbers without gaps."""
    count = staged.count()
    if not count:
        raise ValueError("a selection needs rows")
    kind = np.uint8 if bins <= 256 else np.uint16
    cuts = grown.edges(staged, key, fields, count, bins)
    seen = staged.agg(*[F.bool_and(col(t).isin(0.0, 1.0)) for t in labels], *[F.bool_and((col(t) == F.floor(col(t))) & (col(t) >= 0)) for t in labels], *[F.max(t) for t in map(col, labels)]).first()
    flags, whole, most = (seen[k * len(labels) : (k + 1) * len(labels)] for k in range(3))
    kinds = [np.uint8 if w and m < 256 else np.float64 for w, m in zip(whole, most)]
    block = F.coalesce(F.pmod(cells.hash_int(seed, col(key)), F.lit(block_count(count, rows_per_block))).cast("int"), F.lit(-1)).alias(BLOCK)
    columns = {t: f"y{i}" for i, t in enumerate(labels)}, {f: f"x{i}" for i, f in enumerate(fields)}
    names = [*columns[0].values(), *columns[1].values()]
    width = sum(np.dtype(k).itemsize for k in kinds) + len(fields) * np.dtype(kind).itemsize
    parts = max(min(grown.PARTITIONS, -(-count // grown.PARTITION_ROWS)), -(-count * width // PARTITION_BYTES))
    rows = staged.select(block, cells.hash_hex(f"{seed}.order", col(key)).alias("__h"), *[col(t).cast("double").alias(n) for c in columns for t, n in c.items()])
    dealt = rows.repartition(parts, BLOCK).sortWithinPartitions(BLOCK, "__h").drop("__h")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            values = [b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names))]
            if not all(np.isfinite(v).all() for v in values):
                raise ValueError("a missing or infinite value among labels and features")
            made = [b.column(0).to_numpy(), *[v.astype(k) for v, k in zip(values, kinds)]]
            made += [np.searchsorted(e, v).astype(kind) for e, v in zip(cuts, values[len(kinds) :])]
            held = made if held is None else [np.concatenate(p) for p in zip(held, made)]
            # the last block may go on in the next batch
            ends = np.flatnonzero(np.diff(held[0])) + 1
            if len(ends):
                yield packed(held, ends)
                held = [v[ends[-1] :] for v in held]
        if held is not None and len(held[0]):
            yield packed(held, np.array([len(held[0])]))

    def packed(values: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        texts = [pa.array([v[a:z].tobytes() for a, z in spans], pa.binary()) for v in values[1:]]
        return pa.RecordBatch.from_arrays([pa.array(values[0][ends - 1], pa.int32()), *texts], [BLOCK, *names])

    out = dealt.mapInArrow(pack, f"{BLOCK} int, " + ", ".join(f"{n} binary" for n in names))
    out = out.select(F.spark_partition_id().alias("part"), "*").persist(StorageLevel.MEMORY_AND_DISK)
    whole_most = {t: int(m) if w else None for t, w, m in zip(labels, whole, most)}
    return Blocks(out, *columns, dict(zip(labels, map(bool, flags))), whole_most)


@dataclass
class _Tree:
    """Nodes as they were opened; a node without a split has feature -1, and the right side follows the left one."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    value: list[np.ndarray]
    gain: list[float]
    open: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, gain: float, values: np.ndarray, pure) -> list[int]:
        """Splits a node; the sides that can be split again."""
        self.value[node], left = values[0], len(self.feature)
        if feature < 0:
            return []
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, left, gain
        for v in values[1:]:
            for own, new in zip((self.feature, self.cut, self.left, self.value, self.gain), (-1, 0, -1, v, 0.0)):
                own.append(new)
        return [left + k for k in (0, 1) if not pure(values[1 + k])]

    def prune(self, classes: bool) -> None:
        """Takes splits back whose sides end with the same prediction, as Spark's forests do."""
        for node in range(len(self.feature) - 1, -1, -1):
            left = self.left[node]
            if self.feature[node] >= 0 and self.feature[left] < 0 and self.feature[left + 1] < 0:
                low, high = self.value[left], self.value[left + 1]
                if low.argmax() == high.argmax() if classes else low[0] == high[0]:
                    self.feature[node], self.gain[node] = -1, 0.0


@dataclass
class _Run:
    """A run's inputs: fields, then their copies, rotated by a number drawn for each."""

    number: int
    names: list[str]
    shadows: list[tuple[int, int]]  # field, drawn number
    trees: list[_Tree]


def _read(batches: Iterator[pa.RecordBatch], fields: int, kind, label_kind) -> Iterator[tuple]:
    """``part, blocks, sizes, label, columns`` of many blocks at a time."""
    most = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (2 * fields * np.dtype(kind).itemsize)))
    for batch in batches:
        part = batch.column(0)[0].as_py()
        ids = batch.column(1).to_numpy()
        columns = [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
        sizes = np.array([len(t) for t in columns[0]], np.int64) // np.dtype(label_kind).itemsize
        turn = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(ids)]
        for a, z in zip(cuts, cuts[1:]):
            label, *x = (np.frombuffer(b"".join(c[a:z]), k) for c, k in zip(columns, [label_kind, *[kind] * fields]))
            yield part, ids[a:z], sizes[a:z], label, x


def _rotated(x: np.ndarray, spans: list[tuple[int, int]], draw: int) -> np.ndarray:
    """Each span turned by 1 … size-1 places, drawn (a span of one keeps its value)."""
    out = np.empty_like(x)
    for a, z in spans:
        m = draw % max(z - a - 1, 1) + 1
        out[a : z - m], out[z - m : z] = x[a + m : z], x[a : a + m]
    return out


def _spans(sizes: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends))


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _reached(tree: _Tree, x: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows that come to each node without a split."""
    todo = [(0, rows)]
    while todo:
        node, at = todo.pop()
        f = tree.feature[node]
        if f < 0:
            yield node, at
        elif len(at):
            low = x[f].take(at, mode="clip") <= tree.cut[node]
            todo += [(tree.left[node], at.compress(low)), (tree.left[node] + 1, at.compress(~low))]


def importances(of: Blocks, label: str, fields: Sequence[str], copies: Mapping[int, Sequence[int]], forest) -> dict[int, tuple[list[str], dict[str, float]]]:
    """By run: the names of its shadows, and the importance of each field and shadow. ``copies`` numbers each run's copies of the fields."""
    fields = list(fields)
    runs = []
    for number, drawn in copies.items():
        shadows = [(i, offset_draw(forest.seed, c, f)) for c in drawn for i, f in enumerate(fields)]
        trees = [_Tree([-1], [0], [-1], [np.zeros(1)], [0.0]) for _ in range(forest.trees)]
        runs.append(_Run(number, fields + [shadow_name(f, c) for c in drawn for f in fields], shadows, trees))
    classes = 0
    if forest.classes:
        if of.most[label] is None:
            raise ValueError(f"classes must be whole numbers: {label}")
        classes = of.most[label] + 1
    _grow(of, label, fields, runs, forest, classes)
    if forest.importance == "permutation":
        found = _losses(of, label, fields, runs, forest)
    else:
        found = [_shares(r) for r in runs]
    return {r.number: (r.names[len(fields) :], dict(zip(r.names, v.tolist()))) for r, v in zip(runs, found)}


def _shares(run: _Run) -> np.ndarray:
    """Mean share of each input in the gains of the trees."""
    out = np.zeros(len(run.names))
    for tree in run.trees:
        if (total := sum(tree.gain)) > 0:
            out += np.bincount(np.maximum(tree.feature, 0), tree.gain, len(out)) / total
    return out / out.sum() if out.sum() > 0 else out


def _kinds(of: Blocks, label: str, forest) -> tuple:
    most = of.most[label]
    return np.uint8 if forest.bins <= 256 else np.uint16, np.uint8 if most is not None and most < 256 else np.float64


def _grow(of: Blocks, label: str, fields: list[str], runs: list[_Run], forest, classes: int) -> None:
    bins, counted, channels = forest.bins, bool(classes) or of.flags[label], max(classes, 2)
    sides = (lambda v: v.max() == 1.0) if classes else (lambda v: v[0] in (0.0, 1.0)) if counted else (lambda v: False)
    for level in range(forest.depth):
        items, weight = [[]], 0
        for i, run in enumerate(runs):
            inputs = len(run.names)
            tried = inputs if forest.trees == 1 else math.ceil(math.sqrt(inputs)) if classes else math.ceil(inputs / 3)
            for t, tree in enumerate(run.trees):
                if not tree.open:
                    continue
                draws = np.random.default_rng([forest.seed + run.number, t, level]).random((len(tree.open), inputs))
                size = len(tree.open) * tried * bins * channels * 8
                if items[-1] and weight + size > PASS_BYTES:
                    items.append([])
                    weight = 0
                items[-1].append((i, t, draws.argsort(1)[:, :tried]))
                weight += size
        for some in items:
            if not some:
                continue
            columns = {(i, t): c for i, t, c in some}
            opened = {}
            for i, t, node, feature, cut, gain, values in _pass(of, label, fields, runs, forest, counted, channels, bool(classes), columns):
                tree = runs[i].trees[t]
                opened.setdefault((i, t), []).extend(tree.split(tree.open[node], feature, cut, gain, np.frombuffer(values).reshape(3, -1), sides))
            for i, t in columns:
                runs[i].trees[t].open = opened.get((i, t), [])
    for run in runs:
        for tree in run.trees:
            tree.prune(bool(classes))


def _pass(of: Blocks, label: str, fields: list[str], runs: list[_Run], forest, counted: bool, channels: int, classes: bool, columns: dict[tuple[int, int], np.ndarray]) -> list[tuple]:
    """The best splits ``(run, tree, open node, feature, cut, gain, values)`` of the open nodes in ``columns``, which has the columns each tries."""
    bins, trees, held = forest.bins, forest.trees, forest.importance == "permutation"
    kind, label_kind = _kinds(of, label, forest)
    used = sorted({i for i, _ in columns})
    # rows of few classes are counted by draw of the bag and class, others are weighted
    draws = len(grown._FROM) + 1
    few = counted and draws * channels <= 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {at: np.zeros((*c.shape, channels * bins)) for at, c in columns.items()}
        by_draw = np.arange(draws, dtype=np.float64)
        part = -1
        for part, ids, sizes, y, x in _read(batches, len(fields), kind, label_kind):
            spans, places = _spans(sizes), _places(sizes)
            hashes = (np.repeat(ids.astype(np.uint64), sizes) << np.uint64(32)) + places.astype(np.uint64)
            for i in used:
                run = runs[i]
                all_ = x + [_rotated(x[f], spans, draw) for f, draw in run.shadows]
                trained = (places + run.number) % permutation.HELD != 0 if held else None
                bags = grown.bag(hashes, forest.seed + run.number, trees) if trees > 1 else [np.ones(len(y), np.uint8)]
                for t, bag in enumerate(bags):
                    if (i, t) not in columns:
                        continue
                    tree, total, tries = run.trees[t], sums[i, t], columns[i, t].tolist()
                    at_open = {n: k for k, n in enumerate(tree.open)}
                    weights = bag * trained if held else bag
                    kinds = weights * np.uint8(channels) + y if few else None
                    for node, rows in _reached(tree, all_, np.flatnonzero(weights != 0)):
                        if node not in at_open or not len(rows):
                            continue
                        k = at_open[node]
                        if few:
                            base = kinds.take(rows, mode="clip").astype(np.int64) * bins
                            for j, c in enumerate(tries[k]):
                                found = np.bincount(all_[c].take(rows, mode="clip") + base, minlength=draws * channels * bins)
                                total[k, j] += by_draw @ found.reshape(draws, -1)
                            continue
                        w, label = weights.take(rows).astype(np.float64), y.take(rows)
                        base = label.astype(np.int64) * bins if counted else 0
                        for j, c in enumerate(tries[k]):
                            v = all_[c].take(rows) + base
                            if counted:
                                total[k, j] += np.bincount(v, w, channels * bins)
                            else:
                                total[k, j] += np.concatenate([np.bincount(v, w, bins), np.bincount(v, w * label, bins)])
        if part >= 0:
            made = [[i for i, _ in sums], [t for _, t in sums], [part] * len(sums), [s.tobytes() for s in sums.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["run", "tree", "part", "sums"])

    def choose(table: pa.Table) -> pa.Table:
        run, tree = table.column("run")[0].as_py(), table.column("tree")[0].as_py()
        own, total = columns[run, tree], 0.0
        for _, s in sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist())):
            total = total + np.frombuffer(s)
        stats = total.reshape(*own.shape, channels, bins).transpose(0, 1, 3, 2)
        n, stats = (stats.sum(-1), stats if classes else stats[..., 1:]) if counted else (stats[..., 0], stats[..., 1:])
        return pa.table(list(zip(*grown._splits(run, tree, n, stats, own))) or [[]] * 7, schema=grown._SPLITS)

    found = _columns(of, label, fields).mapInArrow(count, "run int, tree int, part int, sums binary")
    found = found.groupBy("run", "tree").applyInArrow(choose, "run int, tree int, node int, feature int, cut int, gain double, `values` binary")
    return sorted(tuple(r.values()) for r in found.toArrow().to_pylist())


def _columns(of: Blocks, label: str, fields: list[str]) -> DataFrame:
    return of.packed.select("part", BLOCK, of.labels[label], *[of.fields[f] for f in fields])


def _losses(of: Blocks, label: str, fields: list[str], runs: list[_Run], forest) -> list[np.ndarray]:
    """Importance of each run's inputs by the loss of held-out rows (:mod:`broadloom.operators.permutation`)."""
    kind, label_kind = _kinds(of, label, forest)
    draws = [[offset_draw(forest.seed, f"{r.number}.held", n) for n in r.names] for r in runs]
    trees = forest.trees

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((trees, len(r.names))) for r in runs]
        part, seen = -1, np.zeros(len(runs))
        for part, _, sizes, y, x in _read(batches, len(fields), kind, label_kind):
            spans, places = _spans(sizes), _places(sizes)
            block = np.repeat(np.arange(len(sizes)), sizes)
            for i, run in enumerate(runs):
                held = (places + run.number) % permutation.HELD == 0
                seen[i] += held.sum()
                of_block = np.bincount(block[held], minlength=len(sizes))
                held &= (of_block >= 2)[block]
                within = _spans(of_block[of_block >= 2])
                if not within:
                    continue
                mine = [v.compress(held) for v in x] + [_rotated(x[f], spans, draw).compress(held) for f, draw in run.shadows]
                turned = {f: _rotated(mine[f], within, draws[i][f]) for f in {f for t in run.trees for f in t.feature if f >= 0}}
                for t, tree in enumerate(run.trees):
                    for f, loss in _increases(tree, mine, turned, y.compress(held), forest.classes):
                        sums[i][t, f] += loss
        if part >= 0:
            made = [range(len(runs)), [part] * len(runs), seen.tolist(), [s.tobytes() for s in sums]]
            yield pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, (pa.int32(), pa.int32(), pa.float64(), pa.binary()))], ["run", "part", "rows", "sums"])

    def spread(table: pa.Table) -> pa.Table:
        total, rows = 0.0, max(sum(table.column("rows").to_pylist()), 1.0)
        for _, s in sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist())):
            total = total + np.frombuffer(s)
        per_tree = total.reshape(trees, -1) / rows
        out = per_tree.mean(0)
        if trees > 1:
            # equal increases leave rounding errors
            variance = np.maximum((per_tree**2).sum(0) - trees * out**2, 0.0) / (trees - 1)
            out = np.divide(out, np.sqrt(variance / trees), out=np.zeros_like(out), where=variance > 0)
        return pa.table([table.column("run")[:1], pa.array([out.tobytes()], pa.binary())], ["run", "found"])

    found = _columns(of, label, fields).mapInArrow(score, "run int, part int, rows double, sums binary").groupBy("run").applyInArrow(spread, "run int, found binary")
    by_run = {r["run"]: np.frombuffer(r["found"]) for r in found.toArrow().to_pylist()}
    return [by_run[i] for i in range(len(runs))]


def _increases(tree: _Tree, x: list[np.ndarray], turned: dict[int, np.ndarray], y: np.ndarray, classes: bool) -> list[tuple[int, float]]:
    """``(feature, loss)``: what each turned column adds to the loss; only rows below the first node of a feature are followed again."""
    out = []

    def leaf(node: int, rows: np.ndarray) -> float:
        if classes:
            return float(np.count_nonzero(y.take(rows) != tree.value[node].argmax()))
        e = y.take(rows) - tree.value[node][0]
        return float(e @ e)

    def sides(node: int, rows: np.ndarray, column: np.ndarray) -> list[tuple[int, np.ndarray]]:
        low = column.take(rows, mode="clip") <= tree.cut[node]
        return [(tree.left[node], rows.compress(low)), (tree.left[node] + 1, rows.compress(~low))]

    def below(node: int, rows: np.ndarray, f: int) -> float:
        if not len(rows):
            return 0.0
        own = tree.feature[node]
        if own < 0:
            return leaf(node, rows)
        return sum(below(n, r, f) for n, r in sides(node, rows, turned[f] if own == f else x[own]))

    def visit(node: int, rows: np.ndarray, above: frozenset[int]) -> float:
        """The loss of a node's rows as they are."""
        if not len(rows):
            return 0.0
        f = tree.feature[node]
        if f < 0:
            return leaf(node, rows)
        loss = sum(visit(n, r, above | {f}) for n, r in sides(node, rows, x[f]))
        if f not in above:
            out.append((f, below(node, rows, f) - loss))
        return loss

    visit(0, np.arange(len(y)), frozenset())
    return out
