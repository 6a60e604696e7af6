import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from broadloom.operators import binning, encoding, selectors as s
from broadloom.operators.binning import KEEP, BinRule
from broadloom.plans import presets


@pytest.fixture(scope="module")
def places(spark):
    rows = [(1, "a b", "x"), (2, "A B", "y"), (3, "c", None), (4, None, "x")]
    return spark.createDataFrame(rows, "id int, kind string, zone string").coalesce(1)


def test_levels_that_clean_alike_share_a_column(places):
    out = encoding.one_hot(places, ["kind", "zone"])
    assert out.columns == ["id", "KIND_A_B", "KIND_C", "KIND_NA", "ZONE_NA", "ZONE_X", "ZONE_Y"]
    assert [tuple(r) for r in out.collect()] == [
        (1, 1, 0, 0, 0, 1, 0), (2, 1, 0, 0, 0, 0, 1), (3, 0, 1, 0, 1, 0, 0), (4, 0, 0, 1, 0, 1, 0),
    ]


def test_colliding_names_are_an_error(spark):
    df = spark.createDataFrame([("b_c", "c")], "a string, a_b string")
    with pytest.raises(ValueError, match="A_B_C"):
        encoding.one_hot(df, ["a", "a_b"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q r", None]), st.sampled_from(["u", "v"])), min_size=1, max_size=15))
def test_rows_have_one_level_per_field(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    out = encoding.one_hot(df, ["a", "b"])
    for prefix in ("A_", "B_"):
        names = s.starts_with(prefix).names(out)
        assert all(sum(r[n] for n in names) == 1 for r in out.collect())


def test_too_many_levels_is_an_error(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError, match="more than 20 levels"):
        encoding.levels_of(df, ["k"], limit=20)
    assert encoding.levels_of(df, []) == {}


@pytest.mark.parametrize("wide", [5, 400])
def test_dummify_leaves_wide_columns(spark, wide):
    df = spark.range(800).select(
        F.concat(F.lit("k"), (F.col("id") % wide).cast("string")).alias("wide"),
        F.concat(F.lit("v"), (F.col("id") % 4).cast("string")).alias("narrow"), "id",
    )
    assert encoding.dummify(df, 4).columns == ["wide", "id", "narrow_v0", "narrow_v1", "narrow_v2", "narrow_v3"]


def test_target_flags_spell_a_missing_class(spark):
    df = spark.createDataFrame([(1, "B"), (2, "A"), (3, None)], "id int, c string").coalesce(1)
    out = encoding.target_flags(df, "id", "c")
    assert out.columns == ["id", "TARGET_A", "TARGET_B", "TARGET_NA"]
    assert [tuple(r) for r in out.collect()] == [(1, 0, 1, 0), (2, 1, 0, 0), (3, 0, 0, 1)]


def test_one_hot_does_not_exchange_the_data(places):
    levels = encoding.levels_of(places, ["kind"])
    plan = encoding.one_hot(places, ["kind"], levels)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# --- bins ---

RULE = BinRule("kind", {"ONE": ["a b"], "TWO": ["c", "d"]}, missing="UNKNOWN", other="NULL")


def test_missing_unlisted_and_kept(places):
    kinds = lambda rule: [r.kind for r in binning.bin_fields(places, [rule]).collect()]
    assert kinds(RULE) == ["ONE", "NULL", "TWO", "UNKNOWN"]
    assert kinds(BinRule("kind", RULE.bins, missing="EPEOS", other=KEEP)) == ["ONE", "A B", "TWO", "EPEOS"]
    assert kinds(BinRule("kind", {}, other="OTHER", blanks=("c",))) == ["OTHER", "OTHER", "UNKNOWN", "UNKNOWN"]


def test_contradicting_and_null_rules_have_one_answer(spark, places):
    rules = [("kind", "a b", "ZERO"), ("kind", "a b", "ONE"), ("kind", "A B", None), ("kind", "c", "TWO"), ("zone", "y", "Y"), ("other", "x", "Z"), ("kind", None, "N")]
    table = spark.createDataFrame(rules, "var string, val string, bin string")
    settings = [BinRule("kind"), BinRule("zone", missing="NULL", other=KEEP)]
    out = binning.bin_by_table(places, table, settings)
    assert out.columns == places.columns
    got = {r.id: (r.kind, r.zone) for r in out.collect()}
    assert got == {1: ("ONE", "x"), 2: ("NULL", "Y"), 3: ("TWO", "NULL"), 4: ("UNKNOWN", "x")}


def test_rule_text(spark):
    table = spark.createDataFrame([("v", "b", "X"), ("v", "a", "X"), ("v", "c", "Y")], "var string, val string, bin string")
    assert binning.rule_text(table).first()["rule"] == "v IN ('a', 'b') -> 'X',\nv IN ('c') -> 'Y'"


def test_preset_bins_list_no_value_twice():
    rules = [r for r in vars(presets).values() if isinstance(r, BinRule)]
    assert len(rules) == 9
    for rule in rules:
        listed = [v for values in rule.bins.values() for v in values]
        assert len(listed) == len(set(listed))


def test_preset_channel_type(spark):
    df = spark.createDataFrame([(None,), ("Email",), ("Virtual",), ("new",)], "CHANNEL_TYPE string").coalesce(1)
    got = [r[0] for r in binning.bin_fields(df, [presets.CHANNEL_TYPE]).collect()]
    assert got == ["EPEOS", "EMAIL", "VR LP HYB", "F2F OTH"]


def test_levels_with_quotes_and_dots(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",), ("x.y",), (None,)], "`f.g` string").coalesce(1)
    out = encoding.one_hot(df, ["f.g"], clean=False)
    assert out.columns == sorted(["f.g_a\\b", "f.g_it's", "f.g_x.y", "f.g_NA"])
    assert all(sum(r) == 1 for r in out.collect())
