"""Row numbers over whole tables without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from broadloom.operators.selectors import col
from broadloom.session import stage

#: Rows a partition is planned to put in order, and the most partitions to plan; beyond, they hold more.
PART_ROWS = 100_000
MOST_PARTS = 50_000


def numbered(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "position", part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``name``, the place of a row among those with the same ``within`` values, from 0 in ``order`` (nulls first).

    Rows are dealt by ranges and ordered within them; what each partition holds of a group is counted, and sums over the
    partitions before give its first number. So one group may span many partitions, and a single group numbers the
    whole table. Rows that tie in all columns of ``order`` are numbered in either order.
    """
    within = list(within)
    rows = stage(df, "to-number")
    parts = min(-(-rows.count() // part_rows) or 1, MOST_PARTS)
    keys = [col(c) for c in [*within, *order]]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stage(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "in-order")
    held = dealt.groupBy(*[col(c).alias(f"__w{i}") for i, c in enumerate(within)], F.col("__part").alias("__p")).agg(
        F.count("*").alias("__held"), F.min("__at").alias("__first")
    )
    groups = W.partitionBy(*[f"__w{i}" for i in range(len(within))], *([] if within else [F.lit(0)])).orderBy("__p")
    start = (F.sum("__held").over(groups) - F.col("__held")).alias("__start")
    held = held.select(*[f"__w{i}" for i in range(len(within))], "__p", "__first", start)
    same: Column = F.col("__part") == F.col("__p")
    for i, c in enumerate(within):
        same = same & col(c).eqNullSafe(F.col(f"__w{i}"))
    place = (F.col("__start") + F.col("__at") - F.col("__first")).alias(name)
    return dealt.join(held, same).select(*[col(c) for c in rows.columns], place)
