"""Row-wise column functions. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, functions as F

# Missing numbers and missing text are encoded like this throughout.
MISSING_NUMBER = -1
MISSING_TEXT = "NULL"


def clean_name(c: Column) -> Column:
    """Blanks to underscores, upper case."""
    return F.upper(F.replace(c, F.lit(" "), F.lit("_")))


def paste(*cols: Column, sep: str = "_") -> Column:
    """Concatenate; a missing part becomes the text NA (``concat_ws`` would skip it)."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def not_in(c: Column, values: Iterable) -> Column:
    """Complement of a membership test that keeps missing values."""
    return ~F.coalesce(c.isin(list(values)), F.lit(False))


def strong(r: Column, least: float) -> Column:
    """|r| reaches the threshold; NaN does not (in Spark NaN is greater than any number)."""
    return (F.abs(r) >= least) & ~F.isnan(r)


def at_least(r: Column, least: float) -> Column:
    """Signed threshold with the same NaN guard."""
    return (r >= least) & ~F.isnan(r)


def merged_class(c: Column, members: Iterable[str], label: str) -> Column:
    return F.when(c.isin(list(members)), F.lit(label)).otherwise(c)


def text_flag(c: Column, value: str) -> Column:
    return F.when(c == value, 1).otherwise(0)


def count_bin(c: Column, null_as_missing: bool = False) -> Column:
    """Count to NULL / ZERO / 1PLUS.

    Binning comes before missing values are filled, so a true NULL counts as 1PLUS; only the sentinel
    means missing. ``null_as_missing`` treats both alike.
    """
    missing = c == MISSING_NUMBER
    if null_as_missing:
        missing = missing | c.isNull()
    return F.when(missing, MISSING_TEXT).when(c == 0, "ZERO").otherwise("1PLUS")


def total_of(cols: Iterable[Column]) -> Column:
    """Sum across columns, missing as soon as one part is missing."""
    return reduce(add, cols)


def install_bin(total: Column) -> Column:
    """Sum of install flags to 1TO5 / 6PLUS; none, negative and missing all become NULL."""
    return F.when((total > 0) & (total <= 5), "1TO5").when(total >= 6, "6PLUS").otherwise(MISSING_TEXT)


def share_of(part: Column, total: Column) -> Column:
    """Part of a total; missing parts and zero totals give 0."""
    ratio = F.try_divide(part.cast("double"), total.cast("double"))
    return F.coalesce(F.nanvl(ratio, F.lit(0.0)), F.lit(0.0))


def repaired_flag(flag: Column, duplicate: Column) -> Column:
    """1 where the flag is 0 and its duplicate is 1, else 0 (an existing 1 becomes 0 as well)."""
    return F.when((flag == 0) & (duplicate == 1), 1).otherwise(0)


#: What a trend code and a pattern word can be.
TREND_CODES = ("D", MISSING_TEXT, "U")
TREND_WORDS = ("1PLUS_DIFF_UT", "ALL_DOWN", "ALL_NULL", "ALL_UP")


def trend_pattern(cols: list[Column]) -> Column:
    """One word for a row of trend codes: all missing, all up, all down, or mixed."""

    def only(code: str) -> Column:
        return F.coalesce(reduce(and_, [c == code for c in cols]), F.lit(False))

    return (
        F.when(only(MISSING_TEXT), "ALL_NULL")
        .when(only("U"), "ALL_UP")
        .when(only("D"), "ALL_DOWN")
        .otherwise("1PLUS_DIFF_UT")
    )


def sentinel_to_text(c: Column, kind: str) -> Column:
    """Any column as text, the missing-number sentinel replaced by the missing-text word.

    ``kind`` is the column's type name; whole doubles are written without a fraction.
    """
    shown = c.cast("string")
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        shown = F.when(whole, F.floor(c).cast("string")).otherwise(shown)
    return F.when(shown == str(MISSING_NUMBER), MISSING_TEXT).otherwise(shown)


def first_match(field: Column, rules: Iterable[tuple[str, str, str]], other: str) -> Column:
    """Label text by ordered ``(how, pattern, label)`` rules; ``how`` is 'contains' or 'starts'."""
    tests = {"contains": lambda p: field.contains(p), "starts": lambda p: field.startswith(p)}
    label = F
    for how, pattern, name in rules:
        label = label.when(tests[how](pattern), name)
    return F.lit(other) if label is F else label.otherwise(other)


def hash_hex(seed: int | str, *keys: Column) -> Column:
    """md5 of the seed and a row key: the same row gets the same value on any cluster layout."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_int(seed: int | str, *keys: Column) -> Column:
    """The first 32 bits of :func:`hash_hex` as a number."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 8), 16, 10).cast("bigint")
