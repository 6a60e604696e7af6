"""Typed fills and per-column rewrites, each as one ``select`` over the whole width.

A loop of ``withColumn`` over hundreds of columns makes analysis slow; one projection does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame

from broadloom.functions import cells
from broadloom.operators.selectors import Selector, all_of, col, everything, numeric, quoted_name, quoted_text, text


def across(df: DataFrame, which: Selector, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one column function to every chosen column, keeping names and order."""
    chosen = set(which.names(df))
    return df.select(*[fn(col(n)).alias(n) if n in chosen else quoted_name(n) for n in df.columns])


def fill_missing(df: DataFrame, number: float | None = cells.MISSING_NUMBER, word: str | None = cells.MISSING_TEXT):
    """Missing numbers become ``number``, missing text becomes ``word``; other types stay."""
    numbers = set(numeric().names(df)) if number is not None else set()
    words = set(text().names(df)) if word is not None else set()

    def filled(field) -> str:
        c, kind = quoted_name(field.name), field.dataType.simpleString()
        if field.name in numbers:
            known = f"nanvl({c}, CAST(NULL AS {kind}))" if kind in ("double", "float") else c
            return f"coalesce({known}, CAST({number} AS {kind})) AS {c}"
        return f"coalesce({c}, {quoted_text(word)}) AS {c}" if field.name in words else c

    return df.selectExpr(*[filled(f) for f in df.schema])


def clean_text(df: DataFrame) -> DataFrame:
    """:func:`cells.clean_name` on every text column."""
    return across(df, text(), cells.clean_name)


def sentinels_to_text(df: DataFrame, which: Selector | None = None) -> DataFrame:
    """Every chosen column as text with the sentinel -1 spelled out."""
    chosen = set((which or everything()).names(df))
    return df.select(
        *[
            cells.sentinel_to_text(col(f.name), f.dataType.typeName()).alias(f.name) if f.name in chosen else col(f.name)
            for f in df.schema
        ]
    )


def count_bins(df: DataFrame, fields: Iterable[str], null_as_missing: bool = False) -> DataFrame:
    return across(df, all_of(fields), lambda c: cells.count_bin(c, null_as_missing))


def install_count(df: DataFrame, flags: Selector, name: str) -> DataFrame:
    """Replace a group of install flags by one binned count, placed last."""
    used = flags.names(df)
    kept = [col(n) for n in df.columns if n not in set(used) and n != name]
    return df.select(*kept, cells.install_bin(cells.total_of([col(n) for n in used])).alias(name))


def shares(df: DataFrame, parts: Selector, total: str) -> DataFrame:
    """Turn amounts into shares of a total column."""
    return across(df, parts, lambda c: cells.share_of(c, col(total)))
