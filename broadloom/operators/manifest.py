"""Column manifests and their text forms. All inputs are catalogs: one row per column of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def chunked_list(fields: DataFrame, per_line: int = 15) -> DataFrame:
    """Quoted names, sorted and grouped ``(line, code)``.

    The line number is the row number divided without subtracting one, so the first line is one short.
    """
    rank = F.row_number().over(Window.orderBy("field"))
    return (
        fields.select("field", F.floor(rank / per_line).cast("int").alias("line"))
        .groupBy("line")
        .agg(F.expr("listagg(concat('''', field, ''''), ', ') WITHIN GROUP (ORDER BY field)").alias("code"))
    )


def joined_lines(lines: DataFrame) -> DataFrame:
    return lines.agg(F.expr("listagg(code, ',\n') WITHIN GROUP (ORDER BY line)").alias("code"))


def vector_text(fields: DataFrame) -> DataFrame:
    """All names of a catalog ``(ordinal, field)`` as one quoted, comma-separated vector."""
    listed = F.expr("listagg(concat('''', field, ''''), ',') WITHIN GROUP (ORDER BY ordinal)")
    return fields.agg(F.concat(F.lit("c("), listed, F.lit(")")).alias("value"))


def manifest(ids: DataFrame, kept: DataFrame, source: str) -> DataFrame:
    """``(position, field, source)``: id columns first, then kept fields, each in catalog order."""
    both = ids.select(F.lit(0).alias("part"), "ordinal", "field").unionByName(
        kept.select(F.lit(1).alias("part"), "ordinal", "field")
    )
    position = F.row_number().over(Window.orderBy("part", "ordinal"))
    return both.select(position.alias("position"), "field", F.lit(source).alias("source"))


def select_statement(table: DataFrame) -> DataFrame:
    """A manifest as a ``SELECT … FROM …`` statement, one column per line."""
    listed = F.expr("listagg(field, ',\n') WITHIN GROUP (ORDER BY position)")
    statement = F.concat(F.lit("SELECT \n"), listed, F.lit("\nFROM "), F.first("source"))
    return table.agg(statement.alias("statement"))
