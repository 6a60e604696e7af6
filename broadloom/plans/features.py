"""Feature tables built from the star-schema tables: one wide row per order, customer or user.

The large side is always aggregated on its key before it is joined, so a key that holds a large share
of the rows is combined in the map tasks and the joins that follow are one row to one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ORDER_KEY = "o_orderkey"
ORDER_TARGET = "o_orderpriority"
ORDER_NUMBERS = [
    "o_totalprice", "c_acctbal", "line_cnt", "qty_sum", "price_sum", "disc_sum", "tax_sum", "net_sum",
    "ret_cnt", "open_cnt", "qty_max", "ret_flg", "has_line_flg",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_totals(spark: SparkSession, folder: str) -> DataFrame:
    price, share = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias(ORDER_KEY))
        .agg(
            F.count(F.lit(1)).alias("line_cnt"),
            F.sum("l_quantity").alias("qty_sum"),
            F.sum(price).alias("price_sum"),
            F.sum("l_discount").alias("disc_sum"),
            F.sum("l_tax").alias("tax_sum"),
            F.sum(price * share).alias("net_sum"),
            F.count_if(F.col("l_returnflag") == "R").alias("ret_cnt"),
            F.count_if(F.col("l_linestatus") == "O").alias("open_cnt"),
            F.max("l_quantity").alias("qty_max"),
        )
    )


def customer_places(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, folder, "customer").join(nation, "c_nationkey").join(region, "n_regionkey")


def order_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order; line totals are missing for orders without lines."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = orders.join(customer_places(spark, folder), "c_custkey").join(
        line_totals(spark, folder), ORDER_KEY, "left"
    )
    return joined.select(
        ORDER_KEY, ORDER_TARGET, "o_orderstatus", "c_mktsegment", "n_name", "r_name", *ORDER_NUMBERS[:-2],
        F.when(F.col("ret_cnt") > 0, 1).otherwise(0).alias("ret_flg"),
        F.when(F.col("line_cnt").isNull(), 0).otherwise(1).alias("has_line_flg"),
    )


def customer_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer; revenue per priority is missing where a customer has no such order."""
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    totals = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count("o_orderkey").alias("order_cnt"),
            F.sum(price).alias("all_rev_sum"),
            F.sum(F.when(priority == "1-URGENT", price)).alias("p1_rev_sum"),
            F.sum(F.when(priority == "2-HIGH", price)).alias("p2_rev_sum"),
            F.sum(F.when(priority == "3-MEDIUM", price)).alias("p3_rev_sum"),
            F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("has_f"),
            F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("has_p"),
        )
    )
    joined = table(spark, folder, "customer").join(totals, "c_custkey", "left")
    return joined.select(
        "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal",
        F.coalesce("order_cnt", F.lit(0)).alias("all_order_cnt"),
        "all_rev_sum", "p1_rev_sum", "p2_rev_sum", "p3_rev_sum",
        F.coalesce("has_f", F.lit(0)).alias("f_flg"),
        F.coalesce("has_p", F.lit(0)).alias("p_flg"),
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def event_trends(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user with a trend code per event type: U(p), D(own) or NULL.

    The first half of the month is compared with the second half.
    """
    late = F.dayofmonth("ts") > 15
    counts = [
        F.count_if((F.col("event_type") == t) & (late if half else ~late)).alias(f"{t}_{half}")
        for t in EVENT_TYPES
        for half in (0, 1)
    ]
    per_user = table(spark, folder, "events").groupBy("user_id").agg(*counts)
    code = lambda t: (
        F.when(F.col(f"{t}_1") > F.col(f"{t}_0"), "U").when(F.col(f"{t}_1") < F.col(f"{t}_0"), "D").otherwise("NULL")
    )
    return per_user.select("user_id", *[code(t).alias(f"{t}_TREND_CATG") for t in EVENT_TYPES])


MEASURES = ["qty_sum", "line_cnt", "price_sum", "disc_max"]
WIDE_CELLS = [f"{flag}_{status}_{line}" for flag in "ANR" for status in "FO" for line in range(1, 8)]
WIDE_FIELDS = [f"{cell}_{m}" for cell in WIDE_CELLS for m in MEASURES]
#: Lines that one task sums, and whose parts one task of the pivot holds.
LINES_PER_PIVOT = 500_000


def part_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part, one column per line status, line number and measure: a wide, gappy table.

    Lines are dealt by part and cell and summed where they lie; part and cell hardly repeat within a task's input, so
    sums made before the exchange would hold nearly every line in memory. The narrow sums are dealt by part before the
    pivot, so only the task that holds all cells of a part makes its wide row. Both numbers of tasks follow the lines:
    none holds more of them on a larger table.
    """
    lines = table(spark, folder, "lineitem")
    tasks = -(-lines.count() // LINES_PER_PIVOT) or 1
    cell = F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    narrow = lines.select("l_partkey", cell.alias("cell"), "l_quantity", "l_extendedprice", "l_discount")
    sums = narrow.repartition(tasks, "l_partkey", "cell").groupBy("l_partkey", "cell").agg(
        F.sum("l_quantity").alias("qty_sum"),
        F.count(F.lit(1)).alias("line_cnt"),
        F.sum("l_extendedprice").alias("price_sum"),
        F.max("l_discount").alias("disc_max"),
    )
    placed = sums.repartition(tasks, "l_partkey")
    return placed.groupBy("l_partkey").pivot("cell", WIDE_CELLS).agg(*[F.first(m).alias(m) for m in MEASURES])
