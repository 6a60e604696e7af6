"""Permutation importance, concurrent fits and placement."""

import threading
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.operators import fits, forests, importance as imp, permutation, shadows
from broadloom.session import stage


@pytest.fixture(scope="module")
def noisy(spark):
    """A weak binary signal beside noise with as many values as rows."""
    rng = np.random.default_rng(8)
    n = 1800
    signal = rng.integers(0, 2, n)
    target = np.where(rng.random(n) < 0.61, signal, 1 - signal)
    noise = rng.normal(size=(n, 3))
    rows = [(i, int(target[i]), int(signal[i]), *map(float, noise[i]), None if i % 9 else 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, flag int, signal int, n1 double, n2 double, n3 double, gaps double")
    return stage(df.repartition(3), "noisy"), ["signal", "n1", "n2", "n3", "gaps"]


def test_many_valued_noise_ranks_below_a_binary_signal(noisy):
    df, names = noisy
    forest = forests.Forest(trees=20, depth=12, importance="permutation")
    by_loss = forests.all_relevant(df, "id", "flag", names, max_runs=4, forest=forest)
    by_impurity = forests.all_relevant(df, "id", "flag", names, max_runs=4, forest=replace(forest, importance="impurity"))
    ranked = [r.field for r in by_loss.fields.orderBy(F.desc("median_imp")).collect()]
    misled = [r.field for r in by_impurity.fields.orderBy(F.desc("median_imp")).collect()]
    assert ranked[0] == "signal" and misled[0] in ("n1", "n2", "n3")
    # the history has the form that hits and statistics take
    assert by_loss.history.columns == [c.split()[0] for c in imp.HISTORY.split(", ")]
    assert {r.hit for r in imp.hits(by_loss.history).where("field = 'signal'").collect()} == {1}


def test_permutation_decides_like_the_method(noisy):
    df, names = noisy
    forest = forests.Forest(trees=12, depth=5, importance="permutation")
    words = {r.field: r.decision for r in forests.all_relevant(df, "id", "flag", names, max_runs=16, forest=forest).fields.collect()}
    assert words["signal"] == "Confirmed" and "Confirmed" not in {words[n] for n in names[1:]}


@pytest.mark.parametrize("classes", [False, True])
def test_trees_predict_like_the_model(spark, noisy, classes):
    df, names = noisy
    forest = forests.Forest(classes=classes, trees=7, depth=6)
    table = forests.model_table(df, "id", "flag", names, False)
    model = forests._fitted(forest, table, names, 1)
    trees = permutation.trees_of(model)
    assert len(trees) == 7 and all(len(t.feature) == m.numNodes for t, m in zip(trees, model.trees))
    x = np.array([[r[n] for n in names] for r in table.collect()], dtype=float)
    from pyspark.ml.linalg import Vectors

    for tree, fitted in zip(trees, model.trees):
        assert [fitted.predict(Vectors.dense(v)) for v in x[:60]] == pytest.approx(tree.predict(x[:60]).tolist())


def test_losses_are_brute_force(spark):
    """Two blocks, one tree of two splits: every rotated value looked up singly."""
    rng = np.random.default_rng(1)
    blocks = {b: [(float(v), float(w), float(rng.integers(0, 2))) for v, w in rng.integers(0, 9, (n, 2))] for b, n in enumerate((31, 20, 2))}
    df = spark.createDataFrame([([r[0] for r in v], [r[1] for r in v], [r[2] for r in v]) for v in blocks.values()], "a array<double>, b array<double>, label array<double>")
    tree = permutation.Tree(np.array([0, -1, 1, -1, -1]), np.array([3.5, 0, 5.5, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.array([0, 0.25, 0, 0.5, 0.75]))
    predict = lambda a, b: 0.25 if a <= 3.5 else 0.5 if b <= 5.5 else 0.75
    for run in (1, 2, 3):
        got = {(r.tree, r.field): (r.loss, r.rows) for r in permutation.loss_increases(df, "label", ["a", "b"], [tree], run, 7, False).collect()}
        want, held_rows = {0: 0.0, 1: 0.0}, 0
        for rows in blocks.values():
            held = [r for i, r in enumerate(rows) if (i + run) % 3 == 0]
            held_rows += len(held)
            if len(held) < 2:
                continue
            for f, name in enumerate("ab"):
                move = permutation.held_offset(7, run, name, len(held))
                assert 1 <= move < len(held)
                for i, (a, b, y) in enumerate(held):
                    other = held[(i + move) % len(held)][f]
                    turned = predict(other, b) if f == 0 else predict(a, other)
                    want[f] += (turned - y) ** 2 - (predict(a, b) - y) ** 2
        assert got[-1, -1][1] == held_rows
        for f, value in want.items():
            assert got.get((0, f), (0.0, 0))[0] == pytest.approx(value, abs=1e-12)


def test_blocks_are_scored_together(spark, monkeypatch):
    """F2: losses do not depend on how many blocks a call scores; it was one, whatever its size."""
    rng = np.random.default_rng(3)
    rows = [tuple(rng.integers(0, 9, n).astype(float).tolist() for _ in "ab") + ([float(v) for v in rng.integers(0, 2, n)],) for n in (91, 2, 80, 0, 70, 4)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, label array<double>").coalesce(1)
    tree = permutation.Tree(np.array([1, -1, -1]), np.array([3.5, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([0, 0.25, 0.75]))
    found = []
    for many in (1, 4, 64):
        monkeypatch.setattr(permutation, "BLOCKS_AT_ONCE", many)
        got = permutation.loss_increases(df, "label", ["a", "b"], [tree], 1, 7, False).collect()
        found.append(sorted((r.tree, r.field, round(r.loss, 9), r.rows) for r in got))
    assert found[0] == found[1] == found[2] and len(found[0]) == 2


def test_spread_over_trees(spark):
    increases = spark.createDataFrame([(0, 0, 6.0, 0), (1, 0, 2.0, 0), (0, 1, -1.0, 0), (-1, -1, 0.0, 2)], "tree int, field int, loss double, rows long")
    found = permutation.importances(increases, ["a", "b", "c"], 4)
    for name, values in {"a": [3.0, 1.0, 0.0, 0.0], "b": [-0.5, 0.0, 0.0, 0.0]}.items():
        assert found[name] == pytest.approx(np.mean(values) / (np.std(values, ddof=1) / 2))
    assert found["c"] == 0.0
    assert permutation.importances(increases.where("tree <= 0"), ["a", "b"], 1) == {"a": 3.0, "b": -0.5}
    with pytest.raises(ValueError, match="unknown importance"):
        forests.Forest(importance="gain")


def test_one_exchange_for_all_fits(spark, noisy):
    df, names = noisy
    kept = fits.placed(df, "id", 300)
    try:
        assert kept.rdd.getNumPartitions() == 6
        fit = kept.where("id % 5 != 0").select("flag", "signal")
        assert fit.rdd.getNumPartitions() == 6
        shown = fit._jdf.queryExecution().executedPlan().toString()
        fit_only, placement = shown.split("InMemoryRelation", 1)
        assert "Exchange" not in fit_only and "Exchange hashpartitioning(id" in placement
    finally:
        kept.unpersist()


def test_values_cannot_gather_rows(spark):
    same = spark.range(4000).select("id", F.lit(1).alias("flag"), F.lit(0.0).alias("x"))
    kept = fits.placed(same, "id", 500)
    sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    kept.unpersist()
    assert len(sizes) == 8 and max(sizes) < 700


def test_results_do_not_depend_on_slots_or_partitions(noisy):
    df, names = noisy
    forest = forests.Forest(trees=6, depth=4, rows_per_partition=400)
    found = []
    for table, slots in ((df, 1), (df.repartition(7), 3), (df.coalesce(1), 2)):
        one = forests.all_relevant(table, "id", "flag", names, max_runs=5, forest=forest, slots=slots)
        two = forests.recursive_elimination(table, "id", "flag", names, (1, 3), folds=2, repeats=2, forest=forest, slots=slots)
        found.append((sorted(map(tuple, one.history.collect())), sorted(map(tuple, two.resamples.collect())), two.selected))
    assert found[0] == found[1] == found[2]


def test_jobs_run_side_by_side_and_errors_end_them(spark):
    running, most, lock = [0], [0], threading.Lock()

    def job(n):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.2)
        pool = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        with lock:
            running[0] -= 1
        return n, pool

    got = fits.concurrently(spark, [lambda n=n: job(n) for n in range(6)], 3)
    assert [n for n, _ in got] == list(range(6)) and most[0] == 3 and {p for _, p in got} == {"fit-0", "fit-1", "fit-2"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    with pytest.raises(ZeroDivisionError):
        fits.concurrently(spark, [lambda: 1 / 0, lambda: 2], 2)


def test_runs_that_need_not_wait():
    hits = {"a": 0, "b": 0}
    ahead = forests._certain_runs(hits, 0, ["a", "b"], 2)
    assert imp.decide(ahead, ahead, 2) == "Confirmed" and imp.decide(ahead - 1, ahead - 1, 2) == "Tentative"
    assert forests._certain_runs({"a": 8}, 8, ["a"], 12) >= 1


def test_positions_of_array_blocks(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"))
    made = shadows.shadow_blocks(df, "id", ["id", "x"], 2, 3)
    arrays = shadows.shadow_arrays(made, ["id"], ["x"], [1], 3, "at")
    rows = shadows.block_rows(arrays).collect()
    assert len(rows) == 50 and sorted(r["at"] for r in rows)[0] == 0 and set(arrays.columns) == {"id", "shadow_1_x", "at"}
