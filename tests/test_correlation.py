import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from broadloom.operators import correlation, correlation as c


def brute(columns, i, j):
    """Pairwise-complete r of two lists, None where it is undefined."""
    rows = [(a, b) for a, b in zip(columns[i], columns[j]) if not any(v is None or math.isnan(v) for v in (a, b))]
    if len(rows) < 2:
        return None, len(rows)
    x, y = np.array(rows).T
    x, y = x - x.mean(), y - y.mean()
    if np.ptp(x) == 0 or np.ptp(y) == 0 or (x * x).sum() < 1e-20 or (y * y).sum() < 1e-20:
        return None, len(rows)
    return float((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())), len(rows)


def table(spark, columns, parts=3):
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(list(zip(*columns)), schema).repartition(parts), names


def as_dict(pairs):
    return {(r.x, r.y): (r.r, r.n) for r in pairs.collect()}


def agrees(found, columns, pairs, within=1e-9):
    for (i, j), key in pairs.items():
        r, n = brute(columns, i, j)
        got_r, got_n = found[key]
        assert got_n == n, key
        assert (got_r is None) == (r is None), (key, got_r, r)
        if r is not None:
            assert got_r == pytest.approx(r, abs=within), key
    assert len(found) == len(pairs)


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(7)
    n = 200
    base = rng.normal(size=n)
    columns = [
        base, base * 3 + 1e6, -base + rng.normal(size=n) * 0.1, rng.integers(0, 2, n).astype(float),
        np.full(n, 0.1), 1e6 + rng.normal(size=n),
    ]
    columns = [[float(v) for v in col] for col in columns]
    for i in range(n):
        if i % 3 == 0:
            columns[1][i] = None
        if i % 5 == 0:
            columns[2][i] = float("nan")
    columns.append([1.0 if v is not None else None for v in columns[1]])  # constant where present
    columns.append([None] * (n - 1) + [5.0])  # one value only
    columns.append([None] * n)
    return columns


@pytest.mark.parametrize("strategy", ["gram", "expressions"])
def test_every_pair_equals_brute_force(spark, mixed, strategy):
    df, names = table(spark, mixed)
    keys = {(i, j): (names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names))}
    agrees(as_dict(c.correlation_pairs(df, names, strategy=strategy)), mixed, keys)


@pytest.mark.parametrize("strategy", ["gram", "expressions"])
def test_fields_by_targets(spark, mixed, strategy):
    df, names = table(spark, mixed)
    keys = {(i, j): (names[i], names[j]) for i in range(2, 9) for j in (0, 1)}
    agrees(as_dict(c.correlation_pairs(df, names[2:], names[:2], strategy=strategy)), mixed, keys)


def test_constant_over_many_tasks_stays_undefined(spark):
    columns = [[0.1] * 5000, list(np.random.default_rng(1).normal(size=5000).tolist())]
    df, names = table(spark, columns, parts=16)
    assert as_dict(c.correlation_pairs(df, names, strategy="gram"))[("c0", "c1")] == (None, 5000)


def test_tasks_with_different_levels_merge_exactly(spark):
    # partitions whose means differ far more than the values inside them
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500) + 1e5 * k for k in range(8)])
    y = x + rng.normal(size=4000) * 1e4
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "c0 double, c1 double").repartitionByRange(8, "c0")
    got = as_dict(c.correlation_pairs(df, ["c0", "c1"], strategy="gram"))[("c0", "c1")][0]
    assert got == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)


def test_no_rows_and_one_field(spark):
    empty = spark.createDataFrame([], "a double, b double")
    for strategy in ("gram", "expressions"):
        assert as_dict(c.correlation_pairs(empty, ["a", "b"], strategy=strategy)) == {("a", "b"): (None, 0)}
    assert c.correlation_pairs(empty, ["a"], strategy="gram").count() == 0
    assert c.correlation_pairs(empty, ["a"], strategy="expressions").count() == 0


def test_infinite_values_have_no_correlation(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert as_dict(c.correlation_pairs(df, ["a", "b"], strategy="gram"))[("a", "b")][0] is None


def test_wide_table(spark):
    rng = np.random.default_rng(11)
    data = rng.normal(size=(300, 120))
    data[:, 1:] += data[:, :1]
    data[rng.random(data.shape) < 0.1] = np.nan
    import pandas as pd

    names = [f"f{i}" for i in range(120)]
    frame = pd.DataFrame(data, columns=names)
    df = spark.createDataFrame(frame).repartition(4)
    want = frame.corr(min_periods=2).to_numpy()
    rows = c.correlation_pairs(df, names).collect()
    assert len(rows) == 120 * 119 // 2
    assert max(abs(r.r - want[r.x_ord, r.y_ord]) for r in rows) < 1e-9


def test_slices_of_wide_batches_add_up(spark, mixed, monkeypatch):
    df, names = table(spark, mixed)
    whole = as_dict(c.correlation_pairs(df, names, strategy="gram"))
    monkeypatch.setattr(c, "CELLS_PER_STEP", 30)
    sliced = as_dict(c.correlation_pairs(df, names, strategy="gram"))
    for key, (r, n) in whole.items():
        assert sliced[key][1] == n and (sliced[key][0] is None) == (r is None)
        assert r is None or sliced[key][0] == pytest.approx(r, abs=1e-9)


cell = st.one_of(st.none(), st.integers(-3, 3).map(float))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(cell, cell, cell), min_size=1, max_size=12), st.permutations([0, 1, 2]))
def test_column_order_only_turns_pairs_round(spark, rows, order):
    names = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "a double, b double, c double").coalesce(2)
    plain = {frozenset(k): v for k, v in as_dict(c.correlation_pairs(df, names, strategy="gram")).items()}
    turned = {
        frozenset(k): v for k, v in as_dict(c.correlation_pairs(df, [names[i] for i in order], strategy="gram")).items()
    }
    assert plain.keys() == turned.keys()
    for key, (r, n) in plain.items():
        assert turned[key][1] == n
        assert (r is None) == (turned[key][0] is None)
        assert r is None or turned[key][0] == pytest.approx(r, abs=1e-9)


def test_long_forms(spark, mixed):
    df, names = table(spark, mixed)
    pairs = c.correlation_pairs(df, names, strategy="gram")
    square = {(r.x, r.y): r.r for r in c.both_ways(pairs, names).collect()}
    assert len(square) == len(names) ** 2
    assert all(square[(n, n)] is None for n in names)
    assert all(square[(a, b)] == square[(b, a)] for a, b in square)
    known = c.known_pairs(pairs).collect()
    assert all(r.r is not None for r in known)
    wide = c.focus(c.correlation_pairs(df, names[1:], names[:1]), names[:1])
    assert wide.columns == ["term", "c0"] and wide.count() == len(names) - 1


def test_awkward_names(spark):
    names = ["a.b", "it's", "back\\slash", "tick`"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (2.0, 4.0, 1.0, 0.0), (3.0, 5.0, 2.0, 5.0)], names)
    rows = c.correlation_pairs(df, names, strategy="gram").collect()
    assert {(r.x, r.y) for r in rows} == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.sampled_from([1, 3, 16]))
def test_outliers_and_gaps_change_no_other_pair(spark, seed, parts):
    rng = np.random.default_rng(seed)
    n = 120
    base = rng.normal(size=n)
    columns = [base, base + 0.01 * rng.normal(size=n), base * 2 + 1e6, rng.normal(size=n) * 1e9, np.exp(rng.normal(size=n) * 4)]
    columns = [[float(v) for v in c] for c in columns]
    for col in columns[:3]:
        col[int(rng.integers(n))] = float(rng.choice([1e6, 1e9, -1e9]))
    for col in columns:
        for i in rng.choice(n, 20, replace=False):
            col[int(i)] = None
    columns[1][int(np.nanargmax([abs(v) if v is not None else np.nan for v in columns[0]]))] = None
    df, names = table(spark, columns, parts=parts)
    keys = {(i, j): (names[i], names[j]) for i in range(5) for j in range(i + 1, 5)}
    agrees(as_dict(c.correlation_pairs(df, names, strategy="gram")), columns, keys)
    # the running means of the built-in aggregates carry an error of the offset's last digits
    agrees(as_dict(c.correlation_pairs(df, names, strategy="expressions")), columns, keys, 1e-6)


@pytest.mark.parametrize("value", [1e6, 1e7, 1e9])
def test_a_large_first_value_without_partner(spark, value):
    x = [value, *np.random.default_rng(2).normal(size=500).tolist()]
    y = [None, *(float(v + 0.01 * e) for v, e in zip(x[1:], np.random.default_rng(3).normal(size=500)))]
    df, names = table(spark, [x, y], parts=1)
    agrees(as_dict(c.correlation_pairs(df, names, strategy="gram")), [x, y], {(0, 1): tuple(names)})


def _hard_rows(n, width):
    """Gaps, skew, large offsets, a constant, an infinity, columns that never share a row."""
    rng = np.random.default_rng(11)
    x = rng.lognormal(2, 3, (n, width)) + rng.choice([0, 1e7], width)
    x[:, 1] = 5.0
    x[:, 2] = x[:, 3] * 0.5 + rng.normal(size=n)
    x[rng.random((n, width)) < 0.3] = np.nan
    x[: n // 2, 4] = np.nan
    x[n // 2 :, 5] = np.nan
    x[3, 6] = np.inf
    return [[None if np.isnan(v) else float(v) for v in row] for row in x]


def _table(pairs):
    return {(r.x, r.y): (r.n, r.r) for r in pairs.collect()}


def _assert_same(one, two):
    assert one.keys() == two.keys()
    for pair, (n, r) in one.items():
        assert n == two[pair][0]
        assert (r is None) == (two[pair][1] is None) and (r is None or abs(r - two[pair][1]) < 1e-9), pair


def test_both_strategies_tiles_and_groups_agree_on_hard_data(spark):
    names = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame(_hard_rows(600, 11), ", ".join(f"{n} double" for n in names)).repartition(150)
    whole = _table(correlation.correlation_pairs(df, names, strategy="gram"))
    assert len(whole) == 55 and whole["c4", "c5"][0] == 0
    _assert_same(whole, _table(correlation.correlation_pairs(df, names, strategy="expressions")))
    for tile in (1, 4, 11, 50):
        _assert_same(whole, _table(correlation.correlation_pairs(df, names, strategy="gram", tile=tile)))
    sides = _table(correlation.correlation_pairs(df, names[:7], names[5:], strategy="gram", tile=3))
    other = _table(correlation.correlation_pairs(df, names[:7], names[5:], strategy="expressions"))
    _assert_same(sides, other)


def test_lines_are_merged_by_task_groups_first(spark):
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([r[:6] for r in _hard_rows(300, 7)], ", ".join(f"{n} double" for n in names))
    many = df.repartition(200)
    pairs = correlation.correlation_pairs(many, names, strategy="gram")
    shown = pairs._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in shown.splitlines() if "Exchange" in line or "MapInArrow" in line]
    # over all tasks, below it over groups of tasks, below it the summaries
    assert ["Exchange hashpartitioning(x_ord" in line for line in lines[:5]] == [False, True, False, True, False]
    assert "task" in lines[3] and "task" not in lines[1].split("hashpartitioning")[1].split("]")[0].split("REPARTITION")[0]
    _assert_same(_table(pairs), _table(correlation.correlation_pairs(df.coalesce(1), names, strategy="gram")))


def test_no_rows_and_no_fields(spark):
    df = spark.createDataFrame([], "a double, b double, c double")
    assert _table(correlation.correlation_pairs(df, ["a", "b", "c"], strategy="gram", tile=2)) == {("a", "b"): (0, None), ("a", "c"): (0, None), ("b", "c"): (0, None)}
    assert correlation.correlation_pairs(df, [], strategy="gram").count() == 0
    assert correlation.correlation_pairs(df, ["a"], strategy="gram").count() == 0


def test_five_thousand_columns_by_tiles(spark):
    """Wider than one matrix should be: 12.5 million pairs, compared with numpy on some of them."""
    width, rows = 5000, 40
    rng = np.random.default_rng(2)
    x = rng.normal(size=(rows, width))
    packed = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    df = packed.select(*[F.col("v")[i].alias(f"c{i}") for i in range(width)])
    pairs = correlation.correlation_pairs(df, df.columns, strategy="gram")
    some = pairs.where("x_ord % 977 = 0 AND y_ord % 613 = 0").collect()
    assert len(some) > 20 and all(r.n == rows for r in some)
    for r in some:
        assert abs(r.r - np.corrcoef(x[:, r.x_ord], x[:, r.y_ord])[0, 1]) < 1e-9
