"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contract: runs of anything but ASCII white space.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Bytes of an Arrow batch that a Python function gets at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(df: DataFrame, text: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(df[text], F.lit(""))


def utf8(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; ``None`` stands for no rows.

    Batches are handed over in slices of about ``SLICE_BYTES``, which bounds the Python objects alive at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(at, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the data: never a broadcast, whatever size Spark takes them for."""
    return left.join(right.hint("merge"), on, how)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_chars(df: DataFrame, text: str = "text") -> int:
    """Characters of a text column: the size from which numbers of groups are planned (one column scan)."""
    return df.select(F.sum(F.length(text)).alias("n")).first()["n"] or 0


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def kinds_of(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class Remembered(dict):
    """Values of short strings in two bounded generations: those met again move from the old one to the young."""

    def __init__(self, value: Callable[[str], bytes], most: int):
        super().__init__()
        self.value, self.most, self.old = value, most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.value(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out
