"""Joins with the matching rules of the analysts' tables.

Strategy is left to Spark: it broadcasts a side only when its own size estimate is below
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution splits skewed partitions. Joins that
would multiply a hot key are written against distinct or pre-aggregated right sides.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from broadloom.operators.selectors import any_of, col, minus_names, without


def shared_names(left: DataFrame, right: DataFrame) -> list[str]:
    have = set(right.columns)
    return [n for n in left.columns if n in have]


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on every shared column name. With ``null_safe`` missing keys match each other."""
    return keyed_join(left, right, shared_names(left, right), how, null_safe)


def keyed_join(
    left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Join on named keys; other names on both sides get the suffixes ``_x`` and ``_y``."""
    keys = list(keys)
    if not keys:
        raise ValueError("no shared column to join on")
    clash = set(minus_names(shared_names(left, right), keys)) if how in ("inner", "left") else set()
    left = left.select(*[col(n).alias(n + "_x" if n in clash else n) for n in left.columns])
    right = right.select(*[col(n).alias(n + "_y" if n in clash else n) for n in right.columns])
    if not null_safe:
        return left.join(right, keys, how)
    tagged = right.select(*[col(n).alias("__r_" + n if n in keys else n) for n in right.columns])
    on = reduce(and_, [left[f"`{k}`"].eqNullSafe(tagged[f"`__r_{k}`"]) for k in keys])
    joined = left.join(tagged, on, how)
    return joined.select(*[col(n) for n in joined.columns if not n.startswith("__r_")])


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join where the key has another name on the right."""
    return keyed_join(left, right.withColumnRenamed(right_key, left_key), [left_key], "left")


def complement(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not taken. Taken keys are made distinct first: a frequent one costs one row."""
    return df.join(taken.select(col(key)).distinct(), key, "left_anti")


def restrict(df: DataFrame, allowed: DataFrame, key: str, allowed_key: str | None = None) -> DataFrame:
    """Rows whose key is in another table (dictionary restricted to existing columns, and the like)."""
    names = allowed.select(col(allowed_key or key).alias(key)).distinct()
    return df.join(names, key, "left_semi")


def membership_flag(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """1 where the key is listed in ``members``, else 0. Listed keys are made distinct first."""
    kept = df.select(*[col(n) for n in minus_names(df.columns, [flag])])
    listed = members.select(col(key)).where(col(key).isNotNull()).distinct().withColumn(flag, F.lit(1))
    joined = kept.join(listed, key, "left")
    return joined.select(*[col(n) for n in kept.columns], F.coalesce(col(flag), F.lit(0)).alias(flag))


def same_key(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with a comparable key: as they are when the types agree, else both as text.

    A cast key hashes differently, so an unneeded cast would exchange a table once more.
    """
    if left.schema[key].dataType == right.schema[key].dataType:
        return left, right
    return key_as_text(left, key), key_as_text(right, key)


def key_as_text(df: DataFrame, key: str) -> DataFrame:
    return df.select(*[col(n).cast("string").alias(n) if n == key else col(n) for n in df.columns])


def replace_columns(df: DataFrame, updates: DataFrame, key: str, stale: Iterable[str] | None = None) -> DataFrame:
    """Drop stale columns, then left join their new versions; keys of different types match as text.

    ``stale`` names the columns to drop; by default all that ``updates`` brings.
    """
    fresh = minus_names(updates.columns, [key])
    old = list(stale) if stale is not None else fresh
    base, updates = same_key(without(df, any_of(minus_names(set(old) | set(fresh), [key]))), updates, key)
    return base.join(updates, key, "left")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Raise when a key occurs twice; a check for reshapes that need one row per key."""
    twice = df.groupBy(col(key)).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0][0]!r} occurs {twice[0][1]} times")
    return df
