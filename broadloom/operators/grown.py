"""Forests of many resamples grown together: one pass over the rows per level, for all trees of all resamples.

Rows are binned once and kept as blocks of bytes. A pass gives each tree's histograms of its open nodes, per partition;
they are summed by tree, which also picks the splits. Only splits and scores come to the driver. Trees split at the bins'
edges by the gain in variance or Gini, over a third of the columns per node (classes: as many as the square root), as Spark's forests do;
bags are Poisson draws from a hash of the row's key, so they depend on no partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from broadloom.operators.selectors import col

#: Rows from which the bins' edges come, about; Spark's forests take 10,000.
EDGE_ROWS = 20_000
#: Rows of a partition at least, and partitions at most: each sends one histogram per tree and level.
PARTITION_ROWS, PARTITIONS = 20_000, 48
_STEP, _ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A Poisson draw of mean 1 for each 16 bits.
_DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
#: The 16 bits from which on a draw is at least 1, 2, …
_FROM = np.searchsorted(_DRAWS, np.arange(1, int(_DRAWS[-1]) + 1)).astype(np.uint16)


def edges(rows: DataFrame, key: str, fields: Sequence[str], count: int, bins: int) -> list[np.ndarray]:
    """Ascending edges per field, halfway between neighbouring values: all of them, or those at the quantiles."""
    share = min(1.0, EDGE_ROWS / max(count, 1))
    some = rows if share == 1 else rows.where(F.pmod(F.xxhash64(col(key), F.lit("edges")), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = some.select(*[col(f) for f in fields]).toArrow()
    out = []
    for f in range(len(fields)):
        v, n = np.unique(found.column(f).to_numpy(), return_counts=True)
        at = np.arange(len(v) - 1)
        if len(v) > bins:
            at = np.unique(np.searchsorted(n.cumsum(), np.arange(1, bins) * n.sum() / bins))
            at = at[at < len(v) - 1]
        out.append((v[at] + v[at + 1]) / 2)
    return out


def blocks(table: DataFrame, key: str, fields: Sequence[str], folds: Sequence, count: int, bins: int) -> DataFrame:
    """``part, hash, label, folds, bins``: the rows dealt by their key, binned and packed, kept; the caller ends with
    ``unpersist()``."""
    if bins > 256:
        raise ValueError(f"a bin is a byte: {bins} bins")
    cuts = edges(table, key, fields, count, bins)
    parts = min(PARTITIONS, -(-count // PARTITION_ROWS)) or 1
    dealt = table.select(F.xxhash64(col(key)).alias("__hash"), "label", *folds, *[col(f) for f in fields]).repartition(parts, "__hash").sortWithinPartitions("__hash")
    held_at = range(2, 2 + len(folds))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = np.stack([b.column(k).to_numpy() for k in held_at], 1).astype(np.uint8)
            binned = np.stack([np.searchsorted(e, b.column(k).to_numpy()) for k, e in enumerate(cuts, held_at.stop)], 1).astype(np.uint8)
            columns = [b.column(0).to_numpy(), b.column(1).to_numpy(), held, binned]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()]) for c in columns], ["hash", "label", "folds", "bins"])

    packed = dealt.mapInArrow(pack, "hash binary, label binary, folds binary, bins binary")
    return packed.select(F.spark_partition_id().alias("part"), "*").persist(StorageLevel.MEMORY_AND_DISK)


def _read(batches: Iterable[pa.RecordBatch], folds: int, fields: int) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            kinds = (np.uint64, np.float64, np.uint8, np.uint8)
            h, y, held, x = (np.frombuffer(row[n], k) for n, k in zip(("hash", "label", "folds", "bins"), kinds))
            yield row["part"], h, y, held.reshape(-1, folds), x.reshape(-1, fields)


def bag(hashes: np.ndarray, seed: int, trees: int) -> Iterator[np.ndarray]:
    """How often each row is in the bag of each tree."""
    for t in range(trees):
        if t % 4 == 0:
            z = hashes + np.uint64((seed * 1_000_003 + t + 1) * int(_STEP) & (1 << 64) - 1)
            z = (z ^ (z >> np.uint64(30))) * _ONE
            z = (z ^ (z >> np.uint64(27))) * _TWO
            lanes = (z ^ (z >> np.uint64(31))).view(np.uint16).reshape(-1, 4)
        lane = np.ascontiguousarray(lanes[:, t % 4])
        drawn = (lane >= _FROM[0]).view(np.uint8)
        for bits in _FROM[1:]:
            drawn += lane >= bits
        yield drawn


def walk(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """The node of each row after some steps; rows of a node without a split go on to its left, as no bin is above its cut."""
    node = np.zeros(len(base), np.int64)
    for _ in range(steps):
        node = 2 * node + 1 + (flat.take(base + feature.take(node), mode="clip") > cut.take(node, mode="clip"))
    return node


def grow(packed: DataFrame, forest, classes: int, flags: bool, used: dict[tuple[int, int], Sequence[int]], repeats: int, folds: int, fields: int) -> tuple[dict, dict]:
    """Forests per resample ``(repeat, held)`` over its columns ``used``: trees ``(feature, cut, value, open)`` per node, and importance
    per column. ``flags``: the labels are numbers, all 0 or 1, and are counted as two classes are."""
    channels, bins, trees = max(classes, 2), forest.bins, forest.trees
    size = len(next(iter(used.values())))
    tried = size if trees == 1 else math.ceil(math.sqrt(size)) if classes else math.ceil(size / 3)
    runs = list(used)
    all_nodes = 2 ** (forest.depth + 1) - 1
    model = {}
    for r in runs:
        model[r] = [(np.zeros(all_nodes, np.int64), np.full(all_nodes, 255, np.uint8), np.zeros((all_nodes, channels)), np.arange(all_nodes) == 0) for _ in range(trees)]
    gains = {r: np.zeros((trees, all_nodes)) for r in runs}
    for level in range(forest.depth):
        first, width = 2**level - 1, 2**level
        seeds = {r: forest.seed + r[0] * folds + r[1] for r in runs}
        columns = {
            (r, t): np.asarray(used[r])[np.random.default_rng([seeds[r], t, level]).random((width, size)).argsort(1)[:, :tried]] for r in runs for t in range(trees)
        }

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = (trees, width * tried * bins * channels)
            sums, part = {r: np.zeros(shape) for r in runs}, 0
            for part, h, y, held, x in _read(batches, repeats, fields):
                for r in runs:
                    rows = np.flatnonzero(held[:, r[0]] != r[1])
                    xs, ys = x[rows], y[rows]
                    flat, every = xs.ravel(), np.arange(len(rows)) * fields
                    weights = bag(h[rows], seeds[r], trees) if trees > 1 else [np.ones(len(rows), np.uint8)]
                    for t, w in enumerate(weights):
                        feature, cut, _, growing = model[r][t]
                        if not growing[first : first + width].any():
                            continue
                        at = np.flatnonzero(w)
                        base = every[at]
                        node = walk(flat, base, feature, cut, level) - first
                        weight, label = w[at].astype(np.float64), ys[at]
                        mine, tries, whole = node * (tried * bins), columns[r, t], label.astype(np.int64)
                        for k in range(tried):
                            cell = (mine + k * bins) + flat.take(base + tries[:, k].take(node), mode="clip")
                            if classes or flags:
                                sums[r][t] += np.bincount(cell * channels + whole, weight, shape[1])
                            else:
                                half = shape[1] // 2
                                sums[r][t, :half] += np.bincount(cell, weight, half)
                                sums[r][t, half:] += np.bincount(cell, weight * label, half)
            for i, r in enumerate(runs):
                columns_ = [pa.array([i] * trees, pa.int32()), pa.array(range(trees), pa.int32()), pa.array([part] * trees, pa.int32()), pa.array([s.tobytes() for s in sums[r]])]
                yield pa.RecordBatch.from_arrays(columns_, ["run", "tree", "part", "sums"])

        def choose(table: pa.Table) -> pa.Table:
            run, tree = table.column("run")[0].as_py(), table.column("tree")[0].as_py()
            total = 0.0
            for row in sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist())):
                total = total + np.frombuffer(row[1])
            if classes or flags:
                stats = total.reshape(width, tried, bins, channels)
                n, stats = stats.sum(-1), stats if classes else stats[..., 1:]
            else:
                n, stats = total.reshape(2, width, tried, bins)
                stats = stats[..., None]
            return pa.table(list(zip(*_splits(run, tree, n, stats, columns[runs[run], tree]))) or [[]] * 7, schema=_SPLITS)

        counted = packed.mapInArrow(count, "run int, tree int, part int, sums binary")
        split = "run int, tree int, node int, feature int, cut int, gain double, `values` binary"
        for row in counted.groupBy("run", "tree").applyInArrow(choose, split).toArrow().to_pylist():
            r, t, node = runs[row["run"]], row["tree"], first + row["node"]
            feature, cut, value, growing = model[r][t]
            if not growing[node]:
                continue
            value[[node, 2 * node + 1, 2 * node + 2]] = np.frombuffer(row["values"]).reshape(3, -1)
            if row["feature"] >= 0:
                feature[node], cut[node] = row["feature"], row["cut"]
                growing[[2 * node + 1, 2 * node + 2]] = True
                gains[r][t, node] = row["gain"]
    found = {}
    for r in runs:
        shares = np.zeros(fields)
        for tree, gain in zip(model[r], gains[r]):
            _prune(*tree, gain, bool(classes))
            if gain.sum() > 0:
                shares += np.bincount(tree[0], gain, fields) / gain.sum()
        found[r] = shares / shares.sum() if shares.sum() > 0 else shares
    return model, found


def _prune(feature: np.ndarray, cut: np.ndarray, value: np.ndarray, growing: np.ndarray, gain: np.ndarray, classes: bool) -> None:
    """Takes splits back whose sides end with the same prediction, as Spark's forests do; what lies below a node without
    a split has its value."""
    inner = len(feature) // 2
    split = np.concatenate([growing[1::2], np.zeros(len(feature) - inner, bool)])
    for node in range(inner - 1, -1, -1):
        left, right = 2 * node + 1, 2 * node + 2
        if split[node] and not split[left] and not split[right]:
            same = value[left].argmax() == value[right].argmax() if classes else value[left, 0] == value[right, 0]
            if same:
                split[node], feature[node], cut[node], gain[node] = False, 0, 255, 0.0
    for node in range(inner):
        if not split[node]:
            value[[2 * node + 1, 2 * node + 2]] = value[node]


_SPLITS = pa.schema(
    [("run", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("values", pa.binary())]
)


def _splits(run: int, tree: int, n: np.ndarray, stats: np.ndarray, columns: np.ndarray) -> Iterator[tuple]:
    """The best split of each node that has rows: ``n`` by node, tried column and bin, ``stats`` sums of labels or rows of classes."""
    left_n, left = n.cumsum(2), stats.cumsum(2)
    all_n, every = left_n[:, :, -1:], left[:, :, -1:]
    right_n, right = all_n - left_n, every - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2).sum(-1) / left_n + (right**2).sum(-1) / right_n - (every**2).sum(-1) / all_n
    gain = np.where((left_n > 0) & (right_n > 0), gain, -1.0)
    for node in np.flatnonzero(all_n[:, 0, 0] > 0).tolist():
        k, b = np.unravel_index(int(gain[node].argmax()), gain[node].shape)
        best = float(gain[node, k, b])
        # sums of equal labels leave rounding errors
        split = best > 1e-12 * all_n[node, 0, 0]
        sides = [(every[node, k, 0], all_n[node, k, 0]), (left[node, k, b], left_n[node, k, b]), (right[node, k, b], right_n[node, k, b])]
        means = np.array([np.resize(s / max(m, 1.0), max(2, len(s))) for s, m in sides])
        yield run, tree, node, int(columns[node, k]) if split else -1, int(b), best, means.tobytes()


def scores(packed: DataFrame, forest, classes: int, model: dict, repeats: int, fields: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums over the held-out rows of each resample: rows by class and prediction, or for numbers ``n``, squared and absolute errors,
    predictions, labels, their squares and products, and the extremes of the predictions."""
    runs = list(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, y, held, x in _read(batches, repeats, fields):
            out = []
            for r in runs:
                rows = np.flatnonzero(held[:, r[0]] == r[1])
                flat, base, label = x[rows].ravel(), np.arange(len(rows)) * fields, y[rows]
                sums = np.zeros((len(rows), classes or 1))
                for feature, cut, value, _ in model[r]:
                    sums += value[walk(flat, base, feature, cut, forest.depth), : classes or 1]
                if classes:
                    out.append(np.bincount(label.astype(np.int64) * classes + sums.argmax(1), minlength=classes**2).astype(np.float64))
                    continue
                p = sums[:, 0] / len(model[r])
                e = p - label
                both = [len(p), (e * e).sum(), np.abs(e).sum(), p.sum(), label.sum(), (p * p).sum(), (label * label).sum(), (p * label).sum()]
                out.append(np.array([*both, p.min(initial=np.inf), p.max(initial=-np.inf)], np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(runs)), pa.int32()), pa.array([o.tobytes() for o in out])], ["run", "sums"])

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.column("sums").to_pylist())  # always in the same order
        all_ = np.stack([np.frombuffer(s) for s in rows])
        total = all_.sum(0)
        if not classes:
            total[-2:] = all_[:, -2].min(), all_[:, -1].max()
        return pa.table([table.column("run")[:1], pa.array([total.tobytes()])], ["run", "sums"])

    found = packed.mapInArrow(score, "run int, sums binary").groupBy("run").applyInArrow(add, "run int, sums binary")
    return {runs[row["run"]]: np.frombuffer(row["sums"]) for row in found.toArrow().to_pylist()}
