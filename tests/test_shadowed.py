"""Forests of a selection's runs that grow together, against Spark's trees and the losses of single trees."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.operators import forests, permutation, shadowed, shadows

NAMES = ["a", "b", "c", "d"]
SEED = forests.Forest().seed


@pytest.fixture(scope="module")
def numbers(spark):
    """Fields of few whole numbers, all from 0 on, so that a bin is its value; three kinds of labels."""
    rows = [(i, float(i * 7 % 11 + i * 5 % 3 > 6), float((i * 7 % 11 > 6) + (i % 13 > 9)), i * 7 % 11 + i % 13 / 4, *[float(i * p % q) for p, q in ((7, 11), (5, 3), (3, 13), (11, 7))]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, flag double, size double, number double, a double, b double, c double, d double")
    return forests.stage(df.repartition(3), "numbers")


@pytest.fixture(scope="module")
def packed(numbers):
    out = shadowed.blocks(numbers, "id", ["flag", "size", "number"], NAMES, SEED, 32, 100)
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def stored(numbers):
    """The blocks as arrays, as single fits read them."""
    return forests.stage(shadows.shadow_blocks(numbers, "id", ["flag", "size", "number", *NAMES], 30, SEED), "stored")


@pytest.mark.parametrize("label", ["flag", "size", "number"])
@pytest.mark.parametrize("kind", ["impurity", "permutation"])
def test_trees_of_runs_are_those_of_spark(packed, stored, label, kind):
    """F3 to F6: runs once were fits of their own; a tree over all rows is the same in both."""
    forest = forests.Forest(classes=label == "size", trees=1, depth=3, importance=kind)
    copies = {1: [1, 8], 2: [2, 9], 3: [3]}
    found = shadowed.importances(packed, label, NAMES, copies, forest)
    for run, drawn in copies.items():
        names, scores = found[run]
        assert names == [shadows.shadow_name(f, c) for c in drawn for f in NAMES]
        arrays = shadows.shadow_arrays(stored, [label, *NAMES], NAMES, drawn, SEED, permutation.POSITION).withColumnRenamed(label, "label")
        inputs = NAMES + names
        if kind == "impurity":
            want = forests._importances(forest, shadows.block_rows(arrays), inputs, run)[1]
        else:
            model = forests._fitted(forest, shadows.block_rows(arrays).where(permutation.trained(run)), inputs, run)
            losses = permutation.loss_increases(arrays, "label", inputs, permutation.trees_of(model), run, SEED, forest.classes)
            want = permutation.importances(losses, inputs, 1)
        assert scores == pytest.approx(want, abs=1e-9) and max(scores.values()) > 0


@pytest.mark.parametrize("label", ["flag", "size", "number"])
def test_losses_of_a_forest(packed, stored, label, monkeypatch):
    forest = forests.Forest(classes=label == "size", trees=5, depth=4, importance="permutation")
    grown, real = [], shadowed._grow
    monkeypatch.setattr(shadowed, "_grow", lambda *a: (real(*a), grown.extend(a[3])))
    found = shadowed.importances(packed, label, NAMES, {4: [4]}, forest)[4][1]
    trees = []
    for t in grown[0].trees:
        right = [n + 1 if f >= 0 else -1 for n, f in zip(t.left, t.feature)]
        value = [v.argmax() if forest.classes else v[0] for v in t.value]
        trees.append(permutation.Tree(*map(np.array, (t.feature, t.cut, t.left, right, value))))
    assert len({tuple(t.feature) for t in trees}) == 5
    arrays = shadows.shadow_arrays(stored, [label, *NAMES], NAMES, [4], SEED, permutation.POSITION).withColumnRenamed(label, "label")
    losses = permutation.loss_increases(arrays, "label", list(found), trees, 4, SEED, forest.classes)
    assert found == pytest.approx(permutation.importances(losses, list(found), 5), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("label", ["flag", "size", "number"])
def test_passes_and_chunks_change_nothing(packed, label, monkeypatch):
    forest = forests.Forest(classes=label == "size", trees=3, depth=3, importance="permutation")
    calls, real = [], shadowed._pass
    monkeypatch.setattr(shadowed, "_pass", lambda *a: calls.append(len(a[-1])) or real(*a))
    whole = shadowed.importances(packed, label, NAMES, {1: [1], 2: [2]}, forest)
    assert calls == [6, 6, 6]  # a pass per level, for all trees of all runs
    monkeypatch.setattr(shadowed, "PASS_BYTES", 1)
    monkeypatch.setattr(shadowed, "CHUNK_ROWS", 150)
    parts = shadowed.importances(packed, label, NAMES, {1: [1], 2: [2]}, forest)
    assert len(calls) > 12 and max(calls[3:]) == 1
    for run in (1, 2):
        assert parts[run][1] == pytest.approx(whole[run][1], rel=1e-9)


def test_blocks_hold_every_row_once(packed, numbers):
    rows = packed.packed.collect()
    assert len({r[shadows.BLOCK] for r in rows}) == len(rows) == 30
    got = sorted(v for r in rows for v in zip(*[np.frombuffer(r[c], np.float64 if c == "y2" else np.uint8).tolist() for c in ("y0", "y1", "y2", "x0", "x1", "x2", "x3")]))
    assert got == sorted(tuple(r) for r in numbers.drop("id").collect())
    assert packed.flags == {"flag": True, "size": False, "number": False} and packed.most == {"flag": 1, "size": 2, "number": None}


def test_blocks_go_on_over_batches(spark, numbers):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = shadowed.blocks(numbers.limit(500), "id", ["flag"], NAMES, SEED, 32, 100)
        sizes = [len(r["y0"]) for r in out.packed.collect()]
        assert len(sizes) == 5 and sum(sizes) == 500
        out.unpersist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bad_rows_are_errors(spark, numbers):
    forest = forests.Forest(trees=2, depth=2)
    gaps = numbers.withColumn("flag", F.when(F.col("id") > 5, F.col("flag")))
    with pytest.raises(Exception, match="missing or infinite"):
        forests.all_relevant(gaps, "id", "flag", NAMES, 3, forest)
    with pytest.raises(ValueError, match="needs rows"):
        forests.all_relevant(numbers.where("id < 0"), "id", "flag", NAMES, 3, forest)
    with pytest.raises(ValueError, match="whole numbers"):
        forests.chunked_relevance(numbers, "id", ["number"], {0: NAMES}, 3, replace(forest, classes=True))
