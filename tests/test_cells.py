"""Row rules and typed fills, including where missing values behave differently from plain SQL."""

import pytest
from pyspark.sql import functions as F

from broadloom.functions import cells
from broadloom.operators import cleaning, selectors as s


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(-1.0,), (0.0,), (3.0,), (None,)], "v double").coalesce(1)


def test_count_bin_sees_only_the_sentinel_as_missing(numbers):
    assert values(numbers, cells.count_bin(F.col("v"))) == ["NULL", "ZERO", "1PLUS", "1PLUS"]
    assert values(numbers, cells.count_bin(F.col("v"), True)) == ["NULL", "ZERO", "1PLUS", "NULL"]


def test_install_bin_and_missing_parts(spark):
    df = spark.createDataFrame([(1, 1), (3, 4), (0, 0), (-1, -1), (1, None)], "a int, b int").coalesce(1)
    got = values(df, cells.install_bin(cells.total_of([F.col("a"), F.col("b")])))
    assert got == ["1TO5", "6PLUS", "NULL", "NULL", "NULL"]


def test_share_of_total(spark):
    rows = [(1.0, 4.0), (0.0, 0.0), (2.0, 0.0), (None, 3.0), (1.0, None), (float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "a double, t double").coalesce(1)
    assert values(df, cells.share_of(F.col("a"), F.col("t"))) == [0.25, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_repaired_flag_overwrites_ones(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (0, 0), (None, 1)], "a int, b int").coalesce(1)
    assert values(df, cells.repaired_flag(F.col("a"), F.col("b"))) == [1, 0, 0, 0]


def test_thresholds_reject_nan(spark):
    df = spark.createDataFrame([(0.9,), (-0.9,), (float("nan"),), (None,), (0.1,)], "r double").coalesce(1)
    assert values(df.where(cells.strong(F.col("r"), 0.85)), "r") == [0.9, -0.9]
    assert values(df.where(cells.at_least(F.col("r"), 0.85)), "r") == [0.9]


def test_not_in_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string").coalesce(1)
    assert values(df.where(cells.not_in(F.col("c"), ["a"])), "c") == ["b", None]


def test_paste_spells_missing_parts(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string").coalesce(1)
    assert values(df, cells.paste(F.col("x"), F.col("y"))) == ["a_NA", "b_c"]


def test_clean_name(spark):
    df = spark.createDataFrame([("a b  c",)], "x string")
    assert values(df, cells.clean_name(F.col("x"))) == ["A_B__C"]


def test_trend_pattern(spark):
    rows = [("U", "U"), ("D", "D"), ("NULL", "NULL"), ("U", "D"), ("U", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = values(df, cells.trend_pattern([F.col("a"), F.col("b")]))
    assert got == ["ALL_UP", "ALL_DOWN", "ALL_NULL", "1PLUS_DIFF_UT", "1PLUS_DIFF_UT", "1PLUS_DIFF_UT"]


def test_first_match_wins(spark):
    df = spark.createDataFrame([("PAG_X_OFFER_",), ("A_OFFER_B",), ("ZZ",)], "f string").coalesce(1)
    rules = [("starts", "PAG_", "WEB"), ("contains", "_OFFER_", "OFFER")]
    assert values(df, cells.first_match(F.col("f"), rules, "OTHER")) == ["WEB", "OFFER", "OTHER"]
    assert values(df.limit(1), cells.first_match(F.col("f"), [], "OTHER")) == ["OTHER"]


def test_typed_fill(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), (1, 2.5, "x", True), (2, float("nan"), "", False)],
        "i int, d double, t string, b boolean",
    ).coalesce(1)
    filled = cleaning.fill_missing(df)
    assert filled.dtypes == df.dtypes
    assert [tuple(r) for r in filled.collect()] == [(-1, -1.0, "NULL", None), (1, 2.5, "x", True), (2, -1.0, "", False)]


def test_sentinels_to_text(spark):
    df = spark.createDataFrame([(-1, -1.0, "-1"), (7, 2.5, "U"), (8, 3.0, None)], "i int, d double, t string").coalesce(1)
    got = [tuple(r) for r in cleaning.sentinels_to_text(df).collect()]
    assert got == [("NULL", "NULL", "NULL"), ("7", "2.5", "U"), ("8", "3", None)]


def test_across_leaves_other_columns(spark):
    df = spark.createDataFrame([(1, 2, "a")], "x int, y int, t string")
    out = cleaning.across(df, s.any_of(["y"]), lambda c: c * 10)
    assert tuple(out.first()) == (1, 20, "a")


def test_install_count_replaces_its_flags(spark):
    df = spark.createDataFrame([(5, 1, 1)], "id int, INST_A int, INST_B int")
    out = cleaning.install_count(df, s.starts_with("inst_"), "INST")
    assert out.columns == ["id", "INST"] and out.first()["INST"] == "1TO5"
