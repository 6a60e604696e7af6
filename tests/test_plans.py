"""The shape of physical plans: what is read, what is exchanged, what stays in the JVM."""

from pyspark.sql import functions as F

from broadloom.operators import correlation, encoding, ranking, splitting
from broadloom.operators.selectors import minus_names
from broadloom.plans import features as ft

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_correlation_reads_only_its_columns_and_exchanges_only_summaries(spark):
    lines = ft.table(spark, FOLDER, "lineitem")
    fields = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
    shown = plan(correlation.correlation_pairs(lines, fields, strategy="gram"))
    schema = shown.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == set(fields)
    assert shown.count("Exchange") == 1
    above, below = shown.split("Exchange hashpartitioning(x_ord")  # summaries below, their merge above
    assert above.count("MapInArrow") == 1 and below.count("MapInArrow") == 1


def test_few_pairs_stay_in_the_jvm(spark):
    lines = ft.table(spark, FOLDER, "lineitem")
    shown = plan(correlation.correlation_pairs(lines, ["l_quantity", "l_discount", "l_tax"]))
    assert "MapInArrow" not in shown and "BatchEvalPython" not in shown


def test_totals_are_combined_before_the_exchange(spark):
    shown = plan(ft.line_totals(spark, FOLDER))
    assert shown.count("Exchange") == 1 and "partial_sum" in shown
    assert "l_shipdate" not in shown


def test_wide_rows_are_made_after_the_last_exchange(spark, monkeypatch):
    """F7 to F11: partial wide rows once crossed an exchange, one for each part in each task."""
    monkeypatch.setattr(ft, "LINES_PER_PIVOT", 1000)
    lines = ft.table(spark, FOLDER, "lineitem").count()
    shown = plan(ft.part_features(spark, FOLDER))
    above, below = shown.split("Exchange hashpartitioning(l_partkey#", 1)
    assert "pivotfirst" in above and "pivotfirst" not in below and "partial_sum" in below
    assert f", {-(-lines // 1000)}), REPARTITION_BY_NUM" in below.splitlines()[0]


def test_lines_are_summed_by_tasks_that_follow_the_lines(spark, monkeypatch):
    """F8 to F10: sums were once made by as many tasks as the session shuffles to, whatever the lines."""
    monkeypatch.setattr(ft, "LINES_PER_PIVOT", 1000)
    tasks = -(-ft.table(spark, FOLDER, "lineitem").count() // 1000)
    shown = plan(ft.part_features(spark, FOLDER))
    exchanges = [line for line in shown.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all(f", {tasks}), REPARTITION_BY_NUM" in line for line in exchanges)
    assert "cell#" in exchanges[1] and "sum(" not in shown.split(exchanges[1])[1]


def test_top_rows_are_trimmed_before_the_exchange(spark):
    orders = ft.table(spark, FOLDER, "orders")
    shown = plan(ranking.top_per(orders, ["o_orderpriority"], [F.desc("o_totalprice")], 3))
    below = shown[shown.index("Exchange") :]
    assert "WindowGroupLimit" in below


def test_splits_and_flags_are_projections(spark):
    orders = ft.table(spark, FOLDER, "orders")
    for df in (
        splitting.exact_split(orders, "o_orderkey", 0.8, 1),
        splitting.threshold_split(orders, "o_orderkey", 0.8, 1),
        encoding.target_flags(orders, "o_orderkey", "o_orderpriority"),
    ):
        assert "Exchange" not in plan(df)


def test_first_rows_need_no_sort(spark):
    orders = ft.table(spark, FOLDER, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    shown = plan(ranking.first_per(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]))
    assert "Window" not in shown and "partial_min" in shown


def test_filters_reach_the_scan(spark):
    lines = ft.table(spark, FOLDER, "lineitem").where(F.col("l_quantity") > 40)
    assert "GreaterThan(l_quantity,40.0)" in plan(lines.groupBy("l_partkey").count())


def test_unused_totals_are_never_computed(spark):
    df = ft.order_features(spark, FOLDER).select("o_orderkey", "qty_sum")
    schemas = [s.split(">")[0] for s in plan(df).split("ReadSchema: struct<")[1:]]
    assert "l_orderkey:bigint,l_quantity:double" in schemas
    assert minus_names(["l_extendedprice"], ",".join(schemas).split(",")) == ["l_extendedprice"]


def test_large_ranks_are_salted_first(spark):
    from broadloom.operators import ranking

    df = spark.range(30_000).selectExpr("1 AS key", "id AS v")
    top = ranking.top_per(df, ["key"], [F.col("v").desc()], 5000)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number()") >= 2 and "__salt" in plan
    assert sorted(r.v for r in top.collect()) == list(range(25_000, 30_000))
