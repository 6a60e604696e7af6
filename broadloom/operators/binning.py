"""Categorical binning by rule tables.

Rules in code turn into one ``CASE`` per field whose value lists Spark tests by hash set, so binning any
number of fields is a single projection without a join. A rule table has rows ``(var, val, bin)``: it is reduced
to one bin for each field and value (the smallest; rules without a value or bin say nothing) and joined field by
field, whatever its size; Spark sends it to the tasks where it is small.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from broadloom.operators.selectors import col, quoted_name

KEEP = object()


@dataclass(frozen=True)
class BinRule:
    """Bins of one field: ``bins`` maps a bin to its raw values.

    ``missing`` is the bin of missing values, ``other`` that of unlisted ones (``KEEP`` leaves the raw
    value). ``blanks`` lists raw values that count as missing.
    """

    field: str
    bins: Mapping[str, Iterable[str]] = field(default_factory=dict)
    missing: str | None = "UNKNOWN"
    other: object = "NULL"
    blanks: tuple[str, ...] = ()

    def column(self) -> Column:
        c = col(self.field)
        case = F.when(self._is_missing(c), F.lit(self.missing))
        for name, values in self.bins.items():
            case = case.when(c.isin(list(values)), F.lit(name))
        return case.otherwise(self._other(c)).alias(self.field)

    def _is_missing(self, c: Column) -> Column:
        return c.isNull() | c.isin(list(self.blanks)) if self.blanks else c.isNull()

    def _other(self, c: Column) -> Column:
        return c if self.other is KEEP else F.lit(self.other)


def bin_fields(df: DataFrame, rules: Iterable[BinRule]) -> DataFrame:
    """Bin every ruled field in place."""
    by_field = {r.field: r for r in rules}
    return df.select(*[by_field[n].column() if n in by_field else quoted_name(n) for n in df.columns])


def bin_by_table(df: DataFrame, table: DataFrame, settings: Iterable[BinRule]) -> DataFrame:
    """Bin by a rule table ``(var, val, bin)``; ``settings`` gives the missing and other bins."""
    settings = list(settings)
    told = table.where(F.col("val").isNotNull() & F.col("bin").isNotNull())
    out = df
    for s in settings:
        c, hit = col(s.field), f"__bin_{s.field}"
        one = told.where(F.col("var") == s.field).groupBy(F.col("val").alias(s.field)).agg(F.min("bin").alias(hit))
        joined = out.join(one, s.field, "left")
        binned = F.when(s._is_missing(c), F.lit(s.missing)).otherwise(F.coalesce(col(hit), s._other(c)))
        out = joined.select(*[binned.alias(n) if n == s.field else col(n) for n in df.columns])
    return out


def rule_text(table: DataFrame) -> DataFrame:
    """Rule table to readable conditions, one row per field: ``field IN ('a', 'b') -> 'BIN'`` lines."""
    listed = table.groupBy("var", "bin").agg(
        F.expr("listagg(concat('''', val, ''''), ', ') WITHIN GROUP (ORDER BY val)").alias("vals")
    )
    line = F.concat(F.col("var"), F.lit(" IN ("), F.col("vals"), F.lit(") -> '"), F.col("bin"), F.lit("'"))
    return (
        listed.withColumn("line", line)
        .groupBy("var")
        .agg(F.expr("listagg(line, ',\n') WITHIN GROUP (ORDER BY bin)").alias("rule"))
    )
