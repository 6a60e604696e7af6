"""Text and parquet sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, line_breaks: bool = False) -> DataFrame:
    """Header CSV; blank cells and the text NA are missing, blanks around values are trimmed.

    Without a schema Spark reads the whole file once more to infer one: pass a schema for large files. Columns then have
    the names of the header, repaired: a repeated name gets ``.1``, ``.2`` …, an empty one ``X`` and its place.
    A schema names the columns by place, whatever the header says. With ``line_breaks`` quoted cells may hold line
    breaks; records then end where their quotes do, and a file is read by one task, so write many files.
    """
    return _delimited(spark, path, schema, sep=",", escape='"', line_breaks=line_breaks)


def repaired_names(header: Iterable[str | None]) -> list[str]:
    """Column names of a header, each once."""
    made: list[str] = []
    taken: set[str] = set()
    header = [(h or "").strip() or f"X{i}" for i, h in enumerate(header, 1)]
    known = {h.lower() for h in header}
    for name in header:
        new, n = name, 0
        while new.lower() in taken or (n and new.lower() in known):
            n += 1
            new = f"{name}.{n}"
        taken.add(new.lower())
        made.append(new)
    return made


def read_tab(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Tab-separated file with a header; a doubled quote is not an escape, blanks are trimmed."""
    return _delimited(spark, path, schema, sep="\t", escape="\\")


def _delimited(spark, path, schema, sep, escape, line_breaks=False):
    plain = spark.read.option("sep", sep).option("quote", '"').option("escape", escape).option("multiLine", line_breaks)
    # the first record of the first file, as text
    names = repaired_names(plain.csv(path).first() or ()) if schema is None else None
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("multiLine", line_breaks)
        .option("quote", '"')
        .option("escape", escape)
        .option("nullValue", "NA")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if names:
        df = df.toDF(*names)
    # with nullValue=NA an empty text cell stays '', so blank it here as well
    return df.select(
        *[
            F.nullif(_named(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" else _named(f.name)
            for f in df.schema
        ]
    )


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Header CSV, one file per partition; missing cells are written as NA."""
    df.write.option("header", True).option("sep", sep).option("nullValue", "NA").option("emptyValue", "").option(
        "escape", '"' if sep == "," else "\\"
    ).csv(path)


def write_text(one_row: DataFrame, path: str) -> None:
    """Write a one-row, one-column table (a column list, a statement) as one text file."""
    one_row.coalesce(1).write.text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text artefact, ``(value)``."""
    return spark.read.text(path)


def save_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Save named tables for a later session, replacing earlier versions."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Load tables saved by :func:`save_tables`."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
