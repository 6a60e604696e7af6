"""Target flags, one-hot columns and unpivoting.

A pivot would shuffle and regroup the whole table. Here the levels are found first (a small aggregate)
and the 0/1 columns are then one projection: no shuffle of the data, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from broadloom.functions import cells
from broadloom.operators.selectors import Selector, col, minus_names, quoted_name, quoted_text, text

LEVEL_LIMIT = 20_000


def long_form(df: DataFrame, keys: Iterable[str], fields: Iterable[str]) -> DataFrame:
    """Unpivot to ``(keys, var, val)`` with text values."""
    keys, fields = list(keys), list(fields)
    as_text = df.select(*[col(k) for k in keys], *[col(f).cast("string").alias(f) for f in fields])
    return as_text.unpivot(keys, [col(f) for f in fields], "var", "val")


def level_table(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Distinct ``(var, val)`` over all fields in one pass; duplicates go before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("var"), col(f).cast("string").alias("val")) for f in fields])
    return df.select(F.inline(pairs)).distinct()


def levels_of(df: DataFrame, fields: Iterable[str], limit: int = LEVEL_LIMIT) -> dict[str, list[str | None]]:
    """Sorted levels of each field. Levels become columns, so more than ``limit`` is an error."""
    fields = list(fields)
    if not fields:
        return {}
    rows = level_table(df, fields).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} levels in {fields}: too many to become columns; dictionary.sparse_codes has no bound")
    found: dict[str, list[str | None]] = {f: [] for f in fields}
    for var, val in rows:
        found[var].append(val)
    return {f: sorted(v, key=lambda x: (x is None, x)) for f, v in found.items()}


def narrow_levels(df: DataFrame, fields: Iterable[str], most: int) -> dict[str, list[str | None]]:
    """Levels of the fields that have at most ``most`` of them.

    A sketch (fixed memory, one pass) first sets aside fields that are far too wide, such as keys, so
    the exact pass only ever shuffles small level sets.
    """
    fields = list(fields)
    if not fields:
        return {}
    sketch = df.agg(*[F.approx_count_distinct(col(f)).alias(str(i)) for i, f in enumerate(fields)]).first()
    near = [f for i, f in enumerate(fields) if sketch[i] <= 2 * most + 16]
    # 4x head room over the sketch bound covers its error
    found = levels_of(df, near, limit=max(1, len(near)) * (8 * most + 64))
    return {f: v for f, v in found.items() if len(v) <= most}


def _level_flag(field: str, values: Iterable[str | None]) -> str:
    """SQL for 1 where the field has one of the levels (a missing value may be one), else 0."""
    c = f"CAST({quoted_name(field)} AS STRING)"
    values = list(values)
    named = [quoted_text(v) for v in values if v is not None]
    tests = [f"{c} IN ({', '.join(named)})"] if named else []
    tests += [f"{c} IS NULL"] if None in values else []
    return f"CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END"


def level_columns(field: str, levels: Iterable[str | None], clean: bool = True) -> dict[str, Column]:
    """0/1 columns ``field_level`` in name order. Levels that clean to the same name share a column;
    a missing level is called NA."""
    members: dict[str, list[str | None]] = {}
    for v in levels:
        name = f"{field}_{'NA' if v is None else v}"
        members.setdefault(name.replace(" ", "_").upper() if clean else name, []).append(v)
    return {n: F.expr(_level_flag(field, members[n])) for n in sorted(members)}


def one_hot(
    df: DataFrame, fields: Iterable[str], levels: dict[str, list[str | None]] | None = None, clean: bool = True
) -> DataFrame:
    """Replace fields by their 0/1 columns, placed last; other columns keep their order."""
    fields = list(fields)
    levels = levels if levels is not None else levels_of(df, fields)
    rest = minus_names(df.columns, fields)
    made: dict[str, Column] = {}
    for f in fields:
        new = level_columns(f, levels[f], clean)
        clash = [n for n in new if n in made or n in rest]
        if clash:
            raise ValueError(f"one-hot names collide: {clash}")
        made.update(new)
    return df.select(*[quoted_name(n) for n in rest], *[c.alias(n) for n, c in made.items()])


def dummify(df: DataFrame, most: int, which: Selector | None = None) -> DataFrame:
    """One-hot the text columns with at most ``most`` levels; wider ones, such as keys, stay."""
    levels = narrow_levels(df, (which or text()).names(df), most)
    return one_hot(df, list(levels), levels, clean=False)


def flag_columns(label: str, levels: Iterable[str | None]) -> dict[str, Column]:
    """0/1 columns ``TARGET_<class>`` in name order; a missing class is called NA."""
    flags = {f"TARGET_{'NA' if v is None else v}": F.expr(_level_flag(label, [v])) for v in levels}
    return {n: flags[n] for n in sorted(flags)}


def target_flags(df: DataFrame, key: str, label: str, levels: Iterable[str | None] | None = None) -> DataFrame:
    """``(key, TARGET_<class>…)``. Expects one row per key (:func:`joins.assert_unique` checks)."""
    levels = list(levels) if levels is not None else levels_of(df, [label])[label]
    return df.select(col(key), *[c.alias(n) for n, c in flag_columns(label, levels).items()])


def encoded_long(df: DataFrame, key: str, fields: Iterable[str]) -> DataFrame:
    """Long form of the one-hot table: ``(key, var, dummy)`` with cleaned ``field_level`` names."""
    name = cells.clean_name(cells.paste(F.col("var"), F.col("val")))
    return long_form(df, [key], fields).select(col(key), name.alias("var"), F.lit(1).alias("dummy"))
