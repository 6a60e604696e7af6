"""Choosing columns by name, pattern and type.

A selector maps a schema to an ordered list of names. Selectors combine with ``|`` (first operand's
order wins), ``&`` and ``~``. Everything resolves to one static ``select`` before Spark plans, so
pruning reaches the scan. Patterns ignore case, as the analysts' selectors do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructType


class Selector:
    def __init__(self, choose: Callable[[StructType], list[str]]):
        self._choose = choose

    def names(self, df: DataFrame) -> list[str]:
        return self._choose(df.schema)

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda s: union_names(self._choose(s), other._choose(s)))

    def __and__(self, other: Selector) -> Selector:
        return Selector(lambda s: [n for n in self._choose(s) if n in set(other._choose(s))])

    def __invert__(self) -> Selector:
        return Selector(lambda s: minus_names(s.names, self._choose(s)))


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted_text(value: str) -> str:
    """A text literal for SQL expressions. Projections over hundreds of columns are given to Spark as SQL
    text: building them as column objects would keep the driver busy for seconds."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(quoted_name(name))


def _by_name(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda s: [n for n in s.names if test(n)])


def _by_type(*types: type) -> Selector:
    return Selector(lambda s: [f.name for f in s if isinstance(f.dataType, types)])


def starts_with(prefix: str) -> Selector:
    return _by_name(lambda n: n.lower().startswith(prefix.lower()))


def ends_with(suffix: str) -> Selector:
    return _by_name(lambda n: n.lower().endswith(suffix.lower()))


def contains(part: str) -> Selector:
    return _by_name(lambda n: part.lower() in n.lower())


def matches(pattern: str) -> Selector:
    rx = re.compile(pattern, re.IGNORECASE)
    return _by_name(lambda n: rx.search(n) is not None)


def numeric() -> Selector:
    return _by_type(NumericType)


def text() -> Selector:
    return _by_type(StringType)


def logical() -> Selector:
    return _by_type(BooleanType)


def everything() -> Selector:
    return Selector(lambda s: list(s.names))


def all_of(names: Iterable[str]) -> Selector:
    """The listed columns, in list order; unknown names are an error."""
    wanted = list(names)

    def choose(schema: StructType) -> list[str]:
        unknown = minus_names(wanted, schema.names)
        if unknown:
            raise ValueError(f"columns not in the table: {unknown}")
        return wanted

    return Selector(choose)


def any_of(names: Iterable[str]) -> Selector:
    """Those of the listed columns that exist, in list order."""
    wanted = list(names)
    return Selector(lambda s: [n for n in wanted if n in set(s.names)])


def union_names(*lists: Iterable[str]) -> list[str]:
    """Union of name lists, first occurrence kept."""
    return list(dict.fromkeys(n for names in lists for n in names))


def minus_names(names: Iterable[str], removed: Iterable[str]) -> list[str]:
    gone = set(removed)
    return [n for n in names if n not in gone]


def _resolve(df: DataFrame, parts: Iterable[str | Selector]) -> list[str]:
    return union_names(*[p.names(df) if isinstance(p, Selector) else all_of([p]).names(df) for p in parts])


def pick(df: DataFrame, *parts: str | Selector) -> DataFrame:
    """Keep columns in the given order; ``pick(df, 'key', everything())`` moves ``key`` to the front."""
    return df.select(*[quoted_name(n) for n in _resolve(df, parts)])


def without(df: DataFrame, *parts: str | Selector) -> DataFrame:
    """Drop columns; a plain name that is absent is an error (Spark's own drop would be silent)."""
    return df.select(*[quoted_name(n) for n in minus_names(df.columns, _resolve(df, parts))])


def without_except(df: DataFrame, dropped: Iterable[str], spared_pattern: str) -> DataFrame:
    """Drop a list of columns but force back those whose name matches a pattern; these go last."""
    dropped = list(dropped)
    spared = [n for n in dropped if re.search(spared_pattern, n)]
    return pick(df, ~any_of(dropped), all_of(union_names(spared)))


def alphabetical(df: DataFrame) -> DataFrame:
    return df.select(*[quoted_name(n) for n in sorted(df.columns)])


def renamed(df: DataFrame, new_from_old: dict[str, str]) -> DataFrame:
    """Rename ``{new: old}``; an absent old name is an error."""
    all_of(new_from_old.values()).names(df)
    return df.withColumnsRenamed({old: new for new, old in new_from_old.items()})


def plain_names(df: DataFrame) -> DataFrame:
    """Replace dots in names (suffixes of duplicated headers) by underscores."""
    return df.toDF(*[n.replace(".", "_") for n in df.columns])


def field_catalog(df: DataFrame, *parts: str | Selector) -> DataFrame:
    """The schema as a table ``(ordinal, field, type)``; its size is the width of the table."""
    chosen = _resolve(df, parts or (everything(),))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(i, n, types[n]) for i, n in enumerate(chosen)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, field string, type string")


def column_values(df: DataFrame, name: str, limit: int = 100_000) -> list:
    """A catalog-sized column as a list. More than ``limit`` values is an error, never a cut."""
    values = [r[0] for r in df.select(col(name)).limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{name} has more than {limit} values: keep it as a table and join instead")
    return values
