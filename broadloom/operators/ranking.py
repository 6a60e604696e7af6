"""First rows, top-k, fixed-size chunks, unions and profiles."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadloom.functions import cells
from broadloom.operators.selectors import col


#: Ranks up to which Spark trims the groups of a map task (``spark.sql.optimizer.windowGroupLimitThreshold``).
TRIMMED_BY_SPARK = 1000
SALTS = 64


def top_per(df: DataFrame, keys: Iterable[str], order: Iterable[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in the given order, with their rank.

    Spark trims every map-side group to ``k`` rows before the exchange up to ``TRIMMED_BY_SPARK`` rows; for more,
    each group is first ranked in ``SALTS`` parts, so a hot key never goes whole to one task.
    """
    keys, order = list(keys), list(order)
    if k > TRIMMED_BY_SPARK:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[col(n) for n in df.columns]), F.lit(SALTS)))
        part = Window.partitionBy(*[col(n) for n in keys], "__salt").orderBy(*order)
        df = salted.withColumn("__part_rank", F.row_number().over(part)).where(F.col("__part_rank") <= k)
        df = df.drop("__salt", "__part_rank")
    window = Window.partitionBy(*[col(n) for n in keys]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Keep the whole first row per key, ascending by the ``order`` columns (missing values first).

    One aggregation with map-side combine. Rows are structs, which Spark aggregates by sorting within tasks.
    """
    keys, order = list(keys), list(order)
    rest = [n for n in df.columns if n not in keys and n not in order]
    first = F.min(F.struct(*[col(n) for n in order + rest])).alias("__first")
    picked = df.groupBy(*[col(n) for n in keys]).agg(first)
    return picked.select(*[col(n) if n in keys else F.col(f"__first.`{n}`").alias(n) for n in df.columns])


def largest(df: DataFrame, by: Iterable[Column], k: int) -> DataFrame:
    """Global top-k; each task keeps ``k`` rows."""
    return df.orderBy(*by).limit(k)


def ordered(df: DataFrame, up: Iterable[str] = (), down: Iterable[str] = ()) -> DataFrame:
    """Sort with missing values last in both directions."""
    return df.orderBy(*[F.asc_nulls_last(n) for n in up], *[F.desc_nulls_last(n) for n in down])


def numbered_chunks(catalog: DataFrame, order: Iterable[str], size: int, name: str = "chunk") -> DataFrame:
    """Cut a catalog into chunks of ``size`` rows, numbered from 0.

    The row number runs over the whole table: for catalogs (one row per column), not for data.
    """
    rank = F.row_number().over(Window.orderBy(*[col(n) for n in order]))
    return catalog.withColumn(name, F.floor((rank - 1) / size).cast("int"))


def taxonomy(catalog: DataFrame, rules: Iterable[tuple[str, str, str]], other: str = "OTHER") -> DataFrame:
    """Add ``type`` to a field catalog by ordered name rules; the first match wins."""
    return catalog.withColumn("type", cells.first_match(F.col("field"), rules, other))


def stacked(tables: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns a table lacks are missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def cardinality(df: DataFrame, fields: Iterable[str], exact: bool = True) -> DataFrame:
    """``(field, levels)``: distinct non-missing values per column.

    Exact counts deduplicate ``(field, value)`` in each task before the exchange. ``exact=False`` uses
    sketches: one pass and fixed memory, for columns with very many values.
    """
    fields = list(fields)
    if not exact:
        counts = [F.approx_count_distinct(col(f)).alias(f) for f in fields]
        return df.agg(*counts).unpivot([], [col(f) for f in fields], "field", "levels")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), col(f).cast("string").alias("value")) for f in fields])
    distinct = df.select(F.inline(pairs)).distinct()
    return distinct.groupBy("field").agg(F.count("value").alias("levels"))


def rule_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """How often a rule's code equals the actual class, per class.

    ``prct`` is out of all rows of the class, ``prct_pos`` out of those with a prediction. A count
    that does not occur is missing, and so are the shares that need it.
    """
    hit = col(predicted) == col(actual)
    counted = df.groupBy(col(actual).alias(actual)).agg(
        F.count(F.lit(1)).alias("total"),
        F.nullif(F.count(F.when(hit, 1)), F.lit(0)).alias("hits"),
        F.nullif(F.count(F.when(~hit, 1)), F.lit(0)).alias("misses"),
        F.nullif(F.count(F.when(hit.isNull(), 1)), F.lit(0)).alias("unknown"),
    )
    return counted.select(
        "*",
        F.try_divide(F.col("hits"), F.col("total")).alias("prct"),
        F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")).alias("prct_pos"),
    )
