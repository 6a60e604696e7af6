"""From importance history to decisions.

History rows are ``(run, field, importance, is_shadow)``: as many as fields times runs, whatever the
size of the data they came from.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadloom.operators.ranking import first_per, top_per

# Fixed value: the significance level of the published method.
P_VALUE = 0.01

HISTORY = "run int, field string, importance double, is_shadow boolean"


def hits(history: DataFrame, within: Iterable[str] = ()) -> DataFrame:
    """Real fields with ``hit``: importance above the best shadow of the same run.

    ``within`` names columns (target, chunk) whose runs are separate.
    """
    keys = [*within, "run"]
    best = F.max(F.when(F.col("is_shadow"), F.col("importance"))).over(Window.partitionBy(*keys))
    real = history.select(*keys, "field", "importance", "is_shadow", best.alias("shadow_max")).where(~F.col("is_shadow"))
    hit = F.when(F.col("importance") > F.col("shadow_max"), 1).otherwise(0)
    return real.drop("is_shadow").withColumn("hit", hit)


def tail_at_least(hit_count: int, runs: int) -> float:
    """P(X >= hits) for a fair coin thrown ``runs`` times."""
    return sum(math.comb(runs, k) for k in range(max(hit_count, 0), runs + 1)) / 2**runs


def tail_at_most(hit_count: int, runs: int) -> float:
    return 1.0 if hit_count >= runs else sum(math.comb(runs, k) for k in range(0, hit_count + 1)) / 2**runs


def decide(hit_count: int, runs: int, fields: int, p_value: float = P_VALUE) -> str:
    """Confirmed / Rejected / Tentative by two binomial tests, Bonferroni-corrected over the fields."""
    if runs == 0:
        return "Tentative"
    if min(1.0, fields * tail_at_least(hit_count, runs)) < p_value:
        return "Confirmed"
    if min(1.0, fields * tail_at_most(hit_count, runs)) < p_value:
        return "Rejected"
    return "Tentative"


def decision(hit_count: Column, runs: int, fields: int, p_value: float = P_VALUE) -> Column:
    """:func:`decide` as a column: the words for 0 … ``runs`` hits are looked up."""
    words = F.array(*[F.lit(decide(h, runs, fields, p_value)) for h in range(runs + 1)])
    return F.element_at(words, hit_count.cast("int") + 1)


def statistics(hit_rows: DataFrame, runs: int, within: Iterable[str] = ()) -> DataFrame:
    """``(within…, field, mean_imp, median_imp, min_imp, max_imp, norm_hits)`` per field."""
    return hit_rows.groupBy(*within, "field").agg(
        F.avg("importance").alias("mean_imp"),
        F.median("importance").alias("median_imp"),
        F.min("importance").alias("min_imp"),
        F.max("importance").alias("max_imp"),
        (F.sum("hit") / F.lit(runs)).alias("norm_hits"),
    )


def first_listed(ranked: DataFrame, targets: Iterable[str], k: int) -> DataFrame:
    """Combine targets: the best ``k`` fields of each, a field listed twice kept where it came first.

    ``ranked`` has ``(target, field, median_imp, …)``; the result adds the target's ``list_no`` and the
    ``rank`` within it.
    """
    order = [F.desc_nulls_last("median_imp"), F.asc("field")]
    best = top_per(ranked, ["target"], order, k)
    listed = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("target")).alias("list_no")
    return first_per(best.select("*", listed).where("list_no > 0"), ["field"], ["list_no", "rank"])
