"""Dictionaries of levels as tables: columns of any number of levels become numbers or sparse rows.

One-hot columns need their levels in the plan, so :mod:`broadloom.operators.encoding` bounds them. Here the levels stay a
table: found by one aggregate, numbered by ranges and prefix sums, and joined to the rows. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from broadloom.operators import numbering
from broadloom.operators.encoding import level_table, long_form
from broadloom.operators.selectors import col, quoted_text
from broadloom.session import stage


def levels(df: DataFrame, fields: Iterable[str], part_rows: int = numbering.PART_ROWS) -> DataFrame:
    """``(var, val, level)``: the levels of each field as text, numbered from 0 in byte order; missing is no level."""
    known = level_table(df, fields).where("val IS NOT NULL")
    return stage(numbering.numbered(known, ["var"], ["val"], "level", part_rows), "levels")


def with_level(df: DataFrame, field: str, table: DataFrame, name: str, var: str | None = None) -> DataFrame:
    """Add ``name``, the number of the field's level, null for a missing value or one that the table does not have.

    ``var`` is the name of the field in the table if it differs.
    """
    of = table.where(F.col("var") == (var or field)).select(F.col("val").alias("__val"), F.col("level").alias(name))
    return df.join(of, col(field).cast("string") == F.col("__val"), "left").drop("__val")


def columns(table: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(var, val, column, width)``: the one-hot column of every level, fields after one another, and their number.

    The sizes are one row per field.
    """
    order = F.expr(f"array_position(array({', '.join(quoted_text(f) for f in fields)}), var)")
    sizes = table.groupBy("var").agg(F.count("*").alias("__size")).withColumn("__order", order)
    before = (F.sum("__size").over(W.orderBy("__order")) - F.col("__size")).alias("__before")
    sizes = sizes.select("var", before, F.sum("__size").over(W.partitionBy(F.lit(0))).alias("width"))
    return table.join(sizes, "var").select("var", "val", (F.col("__before") + F.col("level")).alias("column"), "width")


def sparse_codes(df: DataFrame, key: str, fields: Sequence[str], table: DataFrame | None = None) -> DataFrame:
    """``(key, width, columns)``: the one-hot row of each key as the ascending numbers of its columns that are 1.

    Any number of levels; missing values and levels that the table does not have set no column. Keys are unique. A key
    without a column has an empty list.
    """
    fields = list(fields)
    table = stage(columns(levels(df, fields) if table is None else table, fields), "columns")
    cells = long_form(df, [key], fields).join(table.select("var", "val", "column"), ["var", "val"], "left")
    width = table.agg(F.max("width")).first()[0] or 0
    rows = cells.groupBy(col(key)).agg(F.array_sort(F.collect_list("column")).alias("columns"))
    return rows.select(col(key), F.lit(width).cast("bigint").alias("width"), "columns")


def model_vectors(codes: DataFrame, name: str = "features") -> DataFrame:
    """Sparse rows as the parts of a sparse vector: ``name`` is ``(size, indices, values)``."""
    ones = F.transform("columns", lambda _: F.lit(1.0))
    vector = F.struct(F.col("width").cast("int").alias("size"), F.col("columns").cast("array<int>").alias("indices"), ones.alias("values"))
    return codes.select(*[col(c) for c in codes.columns if c not in ("width", "columns")], vector.alias(name))
