"""Permutation importance of a fitted forest on held-out rows.

A run holds out every third place of the stored shadow blocks, which are random sets of rows in random order. One input
column at a time is rotated among the held-out rows of each block, and a tree's loss on them is compared with its loss
before: squared error for numbers, wrong votes for classes. A column's importance is the mean of these increases over the
trees divided by their standard error, so a column that now and then helps by chance stays near zero however many cut
points it offers. With one tree there is no spread, and the mean itself is the importance.

Trees are at most a few thousand nodes and travel with the tasks; the rows stay where they are, and what leaves a task is
one number per tree and column used by it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from broadloom.operators.shadows import offset_draw

#: One place of so many is held out.
HELD = 3
#: Blocks that are scored together: enough rows for a call, whatever the size of a block.
BLOCKS_AT_ONCE = 64
POSITION = "__place"

_TEST = re.compile(r"\s*(If|Else) \(feature (\d+) (<=|>) (\S+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


@dataclass
class Tree:
    """Node arrays in depth-first order; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            low = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
        return self.value[at]


def trees_of(model) -> list[Tree]:
    """The trees of a fitted forest over numbers, from its printed form: one call whatever the number of nodes."""
    trees: list[list[list]] = []
    path: list[int] = []  # inner nodes above the next one whose second branch is open
    for line in model.toDebugString.splitlines():
        test, leaf = _TEST.match(line), _LEAF.match(line)
        if line.lstrip().startswith("Tree "):
            trees.append([])
            path = []
        elif test and test[1] == "If":
            _attach(trees[-1], path)
            path.append(len(trees[-1]))
            trees[-1].append([int(test[2]), float(test[4]), -1, -1, 0.0])
        elif leaf:
            _attach(trees[-1], path)
            trees[-1].append([-1, 0.0, -1, -1, float(leaf[1])])
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return [Tree(*(np.array([n[i] for n in nodes], kind) for i, kind in enumerate(kinds))) for nodes in trees]


def _attach(nodes: list[list], path: list[int]) -> None:
    """Hang the next node below the last node of the path: first its left side, then its right one, which ends it."""
    if not path:
        return
    above = nodes[path[-1]]
    if above[2] < 0:
        above[2] = len(nodes)
    else:
        above[3] = len(nodes)
        path.pop()


def trained(run: int) -> Column:
    """The rows that a run trains on."""
    return (F.col(POSITION) + run) % HELD != 0


def held_offset(seed: int, run: int, column: str, rows: int) -> int:
    """How far a column is rotated among ``rows`` held-out rows of a block."""
    return offset_draw(seed, f"{run}.held", column) % max(rows - 1, 1) + 1


def loss_increases(
    arrays: DataFrame, label: str, inputs: Sequence[str], trees: list[Tree], run: int, seed: int, classes: bool
) -> DataFrame:
    """``(tree, field, loss, rows)``: what rotating an input adds to a tree's loss over all held-out rows.

    ``arrays`` has a list of values per block and column. ``field`` is the place in ``inputs``; a row of tree -1 holds
    the number of held-out rows alone.
    """
    inputs = list(inputs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trees), len(inputs)))
        rows = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                some = batch.slice(start, BLOCKS_AT_ONCE)
                columns = [some.column(i).flatten().to_numpy(zero_copy_only=False).astype(float) for i in range(len(inputs) + 1)]
                sizes = some.column(0).value_lengths().to_numpy()
                firsts = np.cumsum(sizes) - sizes
                held = [b + np.flatnonzero((np.arange(n) + run) % HELD == 0) for b, n in zip(firsts, sizes)]
                rows += sum(map(len, held))
                held = [h for h in held if len(h) >= 2]
                if not held:
                    continue
                at = np.concatenate(held)
                y, x = columns[0][at], np.stack([v[at] for v in columns[1:]], 1)
                ends = np.cumsum([0, *map(len, held)])
                turned = {}  # each used column, rotated within its blocks

                def rotated(f: int) -> np.ndarray:
                    if f not in turned:
                        moves = [(a, b, held_offset(seed, run, inputs[f], int(b - a))) for a, b in zip(ends, ends[1:])]
                        turned[f] = np.concatenate([np.roll(x[a:b, f], -move) for a, b, move in moves])
                    return turned[f]

                for t, tree in enumerate(trees):
                    loss = _loss(tree.predict(x), y, classes)
                    for f in np.unique(tree.feature[tree.feature >= 0]):
                        kept = x[:, f].copy()
                        x[:, f] = rotated(f)
                        total[t, f] += (_loss(tree.predict(x), y, classes) - loss).sum()
                        x[:, f] = kept
        t, f = np.nonzero(total)
        columns = [np.append(t, -1), np.append(f, -1), np.append(total[t, f], 0.0), np.append(np.zeros(len(t), np.int64), rows)]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "field", "loss", "rows"])

    parts = arrays.select(label, *[f"`{n}`" for n in inputs]).mapInArrow(score, "tree int, field int, loss double, rows bigint")
    return parts.groupBy("tree", "field").agg(F.sum("loss").alias("loss"), F.sum("rows").alias("rows"))


def _loss(guess: np.ndarray, y: np.ndarray, classes: bool) -> np.ndarray:
    return (guess != y).astype(float) if classes else (guess - y) ** 2


def importances(increases: DataFrame, inputs: Sequence[str], trees: int) -> dict[str, float]:
    """Mean over standard error of each input's increases; what comes to the driver is a row per input."""
    per_field = increases.groupBy("field").agg(F.sum("loss").alias("s"), F.sum(F.col("loss") * F.col("loss")).alias("q"), F.sum("rows").alias("n")).collect()
    rows = max(sum(r["n"] for r in per_field), 1)
    found = dict.fromkeys(inputs, 0.0)
    for r in per_field:
        if r["field"] < 0:
            continue
        mean, square = r["s"] / rows / trees, r["q"] / rows**2
        if trees == 1:
            found[inputs[r["field"]]] = mean
            continue
        variance = max(square - trees * mean * mean, 0.0) / (trees - 1)
        found[inputs[r["field"]]] = mean / math.sqrt(variance / trees) if variance else 0.0
    return found
