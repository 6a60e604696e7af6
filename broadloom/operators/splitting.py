"""Train/test splits and folds by hash.

A row's side depends only on the seed and its key, so a split is the same on every cluster, after a
task is retried, and in SQL. No split shuffles the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadloom.functions import cells
from broadloom.operators.selectors import col

SPACE = 2**32
_STEP = 4
_LENGTH = 32


def threshold_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Add ``part`` (train/test). Sizes are close to the share; one projection, no job."""
    cut = int(share * SPACE)
    return df.withColumn("part", F.when(cells.hash_int(seed, col(key)) < cut, "train").otherwise("test"))


def exact_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Add ``part`` with exactly ``round(share * n)`` train rows: those with the smallest key hashes.

    The cut-off hash is found by counting hash prefixes, four more hex digits per pass over the key
    column only: each pass returns one row, so neither a global sort nor a large limit is needed. Keys
    must be unique.
    """
    hashed = df.select(cells.hash_hex(seed, col(key)).alias("h"))
    total = hashed.count()
    left = int(share * total + 0.5)
    if left <= 0 or left >= total:
        return df.withColumn("part", F.lit("test" if left <= 0 else "train"))
    cutoff = ""
    while len(cutoff) < _LENGTH:
        found = _prefix_at(hashed.where(F.col("h").startswith(cutoff)) if cutoff else hashed, len(cutoff), left)
        cutoff, before, inside = found["prefix"], found["before"], found["inside"]
        left -= before
        if left == inside:
            break
    low = F.substring(cells.hash_hex(seed, col(key)), 1, len(cutoff))
    return df.withColumn("part", F.when(low <= cutoff, "train").otherwise("test"))


def _prefix_at(hashed: DataFrame, known: int, position: int):
    """The prefix that holds the row at ``position``, with the rows before and inside it.

    At most 65,536 prefixes reach the window, whatever the number of rows.
    """
    counts = hashed.groupBy(F.substring("h", 1, known + _STEP).alias("prefix")).agg(F.count(F.lit(1)).alias("inside"))
    running = F.sum("inside").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
    upto = counts.withColumn("upto", running).where(F.col("upto") >= position)
    return upto.orderBy("prefix").select("prefix", "inside", (F.col("upto") - F.col("inside")).alias("before")).first()


def fold(key: Column, folds: int, seed: int, repeat: int = 0) -> Column:
    """Fold number of a row in one repeat of a cross-validation."""
    return (cells.hash_int(f"{seed}.{repeat}", key) % folds).cast("int")
