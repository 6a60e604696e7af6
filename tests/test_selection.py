"""Splits, shadows, importance and forests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadloom.operators import fits, forests, grown, importance as imp, shadows, splitting
from broadloom.operators.fits import placed
from broadloom.session import stage


@pytest.mark.parametrize("n", [0, 1, 2, 10, 997, 70_000])
def test_exact_split_sizes(spark, n):
    df = spark.range(n)
    parts = splitting.exact_split(df, "id", 0.8, 12345)
    train, test = (parts.where(f"part = '{p}'").select("id") for p in ("train", "test"))
    assert train.count() == int(0.8 * n + 0.5)
    assert train.count() + test.count() == n and train.intersect(test).count() == 0


def test_splits_depend_on_seed_and_key_only(spark):
    df = spark.range(1000)
    one = splitting.exact_split(df.repartition(7), "id", 0.5, 1).where("part = 'train'").select("id")
    same = splitting.exact_split(df.coalesce(1), "id", 0.5, 1).where("part = 'train'").select("id")
    other = splitting.exact_split(df, "id", 0.5, 2).where("part = 'train'").select("id")
    assert one.exceptAll(same).count() == 0 and one.exceptAll(other).count() > 100
    whole = splitting.threshold_split(df, "id", 1.0, 1)
    assert whole.where("part = 'test'").count() == 0


def test_folds_are_complete_and_differ_between_repeats(spark):
    df = spark.range(2000)
    folds = df.select("id", *[splitting.fold(F.col("id"), 5, 7, r).alias(f"f{r}") for r in (0, 1)])
    sizes = [r["count"] for r in folds.groupBy("f0").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 2000 and min(sizes) > 300
    assert folds.where("f0 = f1").count() < 800


@pytest.fixture(scope="module")
def blocks(spark):
    df = spark.range(1000).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 10.0).alias("y"))
    return stage(shadows.shadow_blocks(df, "id", ["id", "x", "y"], 4, 99), "blocks")


def test_shadows_permute_each_column(blocks):
    rows = shadows.with_shadows(blocks, ["id", "x", "y"], ["x", "y"], [1, 2], 99).collect()
    assert sorted(r.id for r in rows) == list(range(1000))
    for run in (1, 2):
        for name in ("x", "y"):
            moved = [r[shadows.shadow_name(name, run)] for r in rows]
            assert sorted(moved) == sorted(r[name] for r in rows)
            assert all(a != r[name] for a, r in zip(moved, rows))
            assert abs(np.corrcoef(moved, [r[name] for r in rows])[0, 1]) < 0.2
    assert [r.shadow_1_x for r in rows] != [r.shadow_2_x for r in rows]
    assert [r.shadow_1_x * 10 for r in rows] != [r.shadow_1_y for r in rows]


def test_stored_blocks_are_plain_arrays(blocks):
    """each run once took 1,000 records a block apart again, column by column."""
    assert dict(blocks.dtypes) == {shadows.BLOCK: "int", "id": "array<bigint>", "x": "array<double>", "y": "array<double>"}
    assert sorted(v for r in blocks.select("id").collect() for v in r.id) == list(range(1000))


def test_large_tables_fit_one_forest_at_a_time():
    """four fits of a large table once kept more bagged rows than the executors hold."""
    assert [fits.slots_for(n, 4) for n in (0, 150_000, 2_500_000, 5_000_000, 9_000_000, 54_000_000)] == [4, 4, 4, 2, 1, 1]


def test_shadows_of_tiny_blocks(spark):
    df = spark.range(1).select("id", F.lit(5.0).alias("x"))
    rows = shadows.with_shadows(shadows.shadow_blocks(df, "id", ["x"], 1, 1), ["x"], ["x"], [1], 1).collect()
    assert [tuple(r) for r in rows] == [(5.0, 5.0)]
    assert [shadows.block_count(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


def test_shadows_take_one_exchange(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("x"))
    out = shadows.with_shadows(shadows.shadow_blocks(df, "id", ["x"], 2, 1), ["x"], ["x"], range(1, 4), 1)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_hits_statistics_and_decisions(spark):
    history = [(1, "a", 3.0, False), (1, "b", 1.0, False), (1, "s", 2.0, True)]
    history += [(2, "a", 5.0, False), (2, "b", 2.0, False), (2, "s", 2.0, True)]
    table = spark.createDataFrame(history, imp.HISTORY)
    assert {(r.run, r.field): r.hit for r in imp.hits(table).collect()} == {(1, "a"): 1, (1, "b"): 0, (2, "a"): 1, (2, "b"): 0}
    stats = {r.field: r for r in imp.statistics(imp.hits(table), 2).collect()}
    assert (stats["a"].mean_imp, stats["a"].median_imp, stats["a"].min_imp, stats["a"].max_imp) == (4.0, 4.0, 3.0, 5.0)
    assert stats["a"].norm_hits == 1.0 and stats["b"].norm_hits == 0.0


def test_binomial_decisions():
    assert imp.tail_at_least(10, 10) == 2**-10 and imp.tail_at_most(0, 10) == 2**-10
    assert imp.tail_at_least(0, 5) == pytest.approx(1) and imp.tail_at_most(5, 5) == 1
    # ten hits of ten confirm a field among 10, but not among 11: then the runs only rank
    assert imp.decide(10, 10, 10) == "Confirmed" and imp.decide(10, 10, 11) == "Tentative"
    assert imp.decide(0, 10, 10) == "Rejected" and imp.decide(5, 10, 1) == "Tentative"
    assert imp.decide(0, 0, 3) == "Tentative"
    words = [imp.decide(h, 20, 5) for h in range(21)]
    assert words == sorted(words, key=["Rejected", "Tentative", "Confirmed"].index)
    assert math.isclose(imp.tail_at_least(3, 7) + imp.tail_at_most(2, 7), 1)


def test_first_listed(spark):
    ranked = [("t2", "a", 9.0), ("t2", "b", 8.0), ("t1", "b", 1.0), ("t1", "c", 0.5), ("t1", "d", 0.1), ("t9", "z", 99.0)]
    table = spark.createDataFrame(ranked, "target string, field string, median_imp double")
    got = {r.field: (r.target, r.list_no, r.rank) for r in imp.first_listed(table, ["t1", "t2"], 2).collect()}
    assert got == {"b": ("t1", 1, 1), "c": ("t1", 1, 2), "a": ("t2", 2, 1)}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    n = 1500
    signal = rng.normal(size=(n, 2))
    noise = rng.normal(size=(n, 4))
    flag = (signal[:, 0] + 0.8 * signal[:, 1] > 0).astype(int)
    size = np.where(signal[:, 0] > 0.7, "high", np.where(signal[:, 0] < -0.7, "low", "mid"))
    rows = [
        (i, int(flag[i]), str(size[i]), *map(float, signal[i]), *(None if i % 50 == 0 else float(v) for v in noise[i]))
        for i in range(n)
    ]
    names = ["s1", "s2", "n1", "n2", "n3", "n4"]
    schema = "id long, flag int, size string, " + ", ".join(f"{f} double" for f in names)
    return stage(spark.createDataFrame(rows, schema).repartition(4), "planted"), names


def test_all_relevant_finds_planted_fields(planted):
    df, names = planted
    found = forests.all_relevant(df, "id", "flag", names, max_runs=15, forest=forests.Forest(trees=15, depth=4))
    words = {r.field: r.decision for r in found.fields.collect()}
    assert words["s1"] == words["s2"] == "Confirmed"
    assert all(words[f] != "Confirmed" for f in names[2:])
    stats = {r.field: r for r in found.fields.collect()}
    assert stats["s1"].norm_hits == 1.0 and all(0 <= r.norm_hits <= 1 for r in stats.values())
    per_run = found.history.where("is_shadow").groupBy("run").count().collect()
    assert all(r["count"] >= forests.LEAST_SHADOWS for r in per_run)


def test_all_relevant_with_classes(planted):
    df, names = planted
    forest = forests.Forest(classes=True, trees=15, depth=4)
    found = forests.all_relevant(df, "id", "size", names, max_runs=5, forest=forest).fields.collect()
    best = sorted(found, key=lambda r: -r.median_imp)
    assert best[0].field == "s1" and {r.field for r in found} == set(names)


def test_key_or_target_as_feature_is_an_error(planted):
    df, names = planted
    with pytest.raises(ValueError, match="cannot be features"):
        forests.all_relevant(df, "id", "flag", ["id", *names])


def test_chunked_relevance_goes_on_where_it_stopped(planted, tmp_path, monkeypatch):
    df, names = planted
    df = df.withColumn("other", F.when(F.col("n1") > 0, 1).otherwise(0))
    chunks, folder = {0: names[:3], 1: names[3:]}, str(tmp_path / "relevance")
    settings = {"max_runs": 3, "forest": forests.Forest(trees=10, depth=3), "folder": folder}
    part = forests.chunked_relevance(df, "id", ["flag", "other"], {0: chunks[0]}, **settings)
    assert part.count() == 6
    fits = []
    real = forests._relevance
    monkeypatch.setattr(forests, "_relevance", lambda b, t, f, *a: fits.append((t, f)) or real(b, t, f, *a))
    out = forests.chunked_relevance(df, "id", ["flag", "other"], chunks, **settings)
    assert sorted(fits) == [("flag", names[3:]), ("other", names[3:])]
    rows = out.collect()
    assert len(rows) == 12 and {(r.target, r.chunk) for r in rows} == {(t, c) for t in ("flag", "other") for c in (0, 1)}
    best = max((r for r in rows if r.target == "other"), key=lambda r: r.median_imp)
    assert best.field == "n1"
    # other results in the folder are not handed out, other settings are not taken for these
    narrower = forests.chunked_relevance(df, "id", ["flag"], {0: chunks[0]}, **settings)
    assert {(r.target, r.field) for r in narrower.collect()} == {("flag", n) for n in chunks[0]} and len(fits) == 2
    forests.chunked_relevance(df, "id", ["flag"], {0: chunks[0][:2]}, **settings)
    assert len(fits) == 3


def test_fits_do_not_depend_on_the_partitions(planted):
    df, names = planted
    forest = forests.Forest(trees=8, depth=3, rows_per_partition=100)
    table = forests.model_table(df, "id", "flag", names, False)
    kept = [placed(table.repartition(n), "id", forest.rows_per_partition) for n in (1, 3, 8)]
    found = [forests._importances(forest, rows, names, 1)[1] for rows in kept]
    assert found[0] == found[1] == found[2]
    for rows in kept:
        rows.unpersist()


@pytest.mark.parametrize("classes, target", [(False, "flag"), (True, "size")])
def test_recursive_elimination(planted, classes, target):
    df, names = planted
    found = forests.recursive_elimination(
        df, "id", target, names, sizes=(1, 2, 99), folds=2, repeats=1,
        forest=forests.Forest(classes=classes, trees=10, depth=4),
    )
    metrics = {"Accuracy", "Kappa"} if classes else {"RMSE", "MAE", "Rsquared"}
    profile = found.profile.collect()
    assert {r["size"] for r in profile} == {1, 2, 6} and {r.metric for r in profile} == metrics
    assert found.selected[0] == "s1"
    if not classes:
        assert len(found.selected) >= 2
    assert found.resamples.count() == 2 * 3 * len(metrics)


def test_kappa_against_its_definition(spark):
    rows = [(0.0, 0.0)] * 6 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 1
    df = spark.createDataFrame(rows, "label double, prediction double")
    got = forests._scores(df, True)
    chance = (8 / 12) * (7 / 12) + (4 / 12) * (5 / 12)
    assert got["Accuracy"] == 9 / 12 and got["Kappa"] == pytest.approx((9 / 12 - chance) / (1 - chance))


def test_registered_boruta_confirms_and_rejects(spark):
    import __spark_entry__ as contract

    rows = contract.queries()["boruta_forest"](spark, "/root/testdata/sf0.001").collect()
    assert {"Confirmed", "Rejected"} <= {r["decision"] for r in rows}


@pytest.mark.parametrize("classes", [False, True])
def test_jointly_grown_trees_are_those_of_spark(spark, classes):
    rows = [(i, float((i * 7 % 11 + i * 5 % 3 > 6) + classes * (i % 13 > 9)), *[float(i * p % q) for p, q in ((7, 11), (5, 3), (3, 13), (11, 7))]) for i in range(3000)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double, c double, d double")
    forest = forests.Forest(classes=classes, trees=1, depth=3)
    numbers = [forests.fold(F.col("id"), 3, 5, r).alias(f"__fold_{r}") for r in range(2)]
    packed = grown.blocks(df, "id", names, numbers, 3000, 32)
    used = {(r, h): range(4) for r in range(2) for h in range(3)}
    model, shares = grown.grow(packed, forest, 3 if classes else 0, not classes, used, 2, 3, 4)
    sums = grown.scores(packed, forest, 3 if classes else 0, model, 2, 4)
    packed.unpersist()
    for r, h in used:
        train, test = (df.select("*", *numbers).where((F.col(f"__fold_{r}") == h) == held) for held in (False, True))
        fitted, found = forests._importances(forest, train, names, r * 3 + h)
        assert shares[r, h].tolist() == pytest.approx([found[n] for n in names], abs=1e-9)
        seen = fitted.transform(forests.VectorAssembler(inputCols=names, outputCol="features").transform(test))
        if classes:
            want = forests._scores(seen, True)
        else:
            want = seen.selectExpr("sqrt(avg(pow(prediction - label, 2))) RMSE", "avg(abs(prediction - label)) MAE", "regr_r2(label, prediction) Rsquared").first().asDict()
        assert forests._metrics(sums[r, h], 3 if classes else 0) == pytest.approx(want, abs=1e-9)


def test_resamples_share_their_passes(planted, monkeypatch):
    df, names = planted
    calls, real = [], grown.grow
    monkeypatch.setattr(grown, "grow", lambda *a: calls.append(len(a[4])) or real(*a))
    forests.recursive_elimination(df, "id", "flag", names, (1,), folds=3, repeats=2, forest=forests.Forest(trees=4, depth=2))
    assert calls == [6, 6]
    bags = np.array(list(grown.bag(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64), 7, 6)))
    assert abs(bags.mean() - 1) < 0.01 and abs(bags.var() - 1) < 0.02 and np.abs(np.corrcoef(bags) - np.eye(6)).max() < 0.02
