import pytest
from pyspark.sql import functions as F

from broadloom.operators import selectors as s


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(1).select(
        F.lit("k").alias("Key"), F.lit(1).alias("INTR_A_CNT"), F.lit(1.5).alias("intr_b_FLG"),
        F.lit("x").alias("PAG_C"), F.lit(True).alias("ok"), F.lit(2).alias("dup.1"),
    )


def test_patterns_ignore_case(wide):
    assert s.starts_with("intr_").names(wide) == ["INTR_A_CNT", "intr_b_FLG"]
    assert s.ends_with("_flg").names(wide) == ["intr_b_FLG"]
    assert s.contains(".1").names(wide) == ["dup.1"]
    assert s.matches("INTR_.*FLG").names(wide) == ["intr_b_FLG"]


def test_types(wide):
    assert s.numeric().names(wide) == ["INTR_A_CNT", "intr_b_FLG", "dup.1"]
    assert s.text().names(wide) == ["Key", "PAG_C"]
    assert s.logical().names(wide) == ["ok"]


def test_algebra_keeps_the_first_operands_order(wide):
    assert (s.ends_with("flg") | s.starts_with("intr")).names(wide) == ["intr_b_FLG", "INTR_A_CNT"]
    assert (s.numeric() & ~s.contains("intr")).names(wide) == ["dup.1"]


def test_strict_and_tolerant_lists(wide):
    assert s.any_of(["gone", "ok"]).names(wide) == ["ok"]
    with pytest.raises(ValueError, match="gone"):
        s.all_of(["gone"]).names(wide)
    with pytest.raises(ValueError, match="gone"):
        s.without(wide, "gone")
    with pytest.raises(ValueError, match="gone"):
        s.renamed(wide, {"new": "gone"})


def test_shapes(wide):
    assert s.pick(wide, "ok", s.everything()).columns[:2] == ["ok", "Key"]
    assert s.without(wide, s.text(), "ok").columns == ["INTR_A_CNT", "intr_b_FLG", "dup.1"]
    assert s.without_except(wide, ["Key", "PAG_C"], "^PAG").columns[-1] == "PAG_C"
    assert "Key" not in s.without_except(wide, ["Key", "PAG_C"], "^PAG").columns
    assert s.alphabetical(wide).columns == sorted(wide.columns)
    assert s.plain_names(wide).columns[-1] == "dup_1"
    assert s.renamed(wide, {"id": "Key"}).columns[0] == "id"


def test_catalog_and_values(spark, wide):
    rows = s.field_catalog(wide, s.numeric()).collect()
    assert [(r.ordinal, r.field, r.type) for r in rows] == [
        (0, "INTR_A_CNT", "int"), (1, "intr_b_FLG", "decimal(2,1)"), (2, "dup.1", "int"),
    ] or rows[1].type == "double"
    assert s.column_values(spark.range(3), "id", 3) == [0, 1, 2]
    with pytest.raises(ValueError, match="more than 2"):
        s.column_values(spark.range(3), "id", 2)


def test_name_lists():
    assert s.union_names(["b", "a"], ["a", "c"]) == ["b", "a", "c"]
    assert s.minus_names(["a", "b", "c"], ["b", "z"]) == ["a", "c"]


def test_pruning_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = s.pick(df, s.starts_with("l_tax"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan
