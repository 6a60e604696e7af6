"""From correlated pairs to a drop list. Every table here has at most one row per pair of columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from broadloom.functions import cells
from broadloom.session import discard, stage


def correlated(pairs: DataFrame, strength: float = 0.85, signed: float | None = None) -> DataFrame:
    """Pairs with |r| at the threshold, and r itself at ``signed`` if given."""
    cut = pairs.where((F.col("x_ord") < F.col("y_ord")) & cells.strong(F.col("r"), strength))
    return cut if signed is None else cut.where(cells.at_least(F.col("r"), signed))


def knock_outs(cut: DataFrame) -> DataFrame:
    """``(field, knocked_out_by, r)``: for each later field the first earlier field, by name, that beats it.

    Not transitive: a field may be knocked out by one that is itself dropped; override lists repair that.
    """
    best = cut.groupBy(F.col("y").alias("field")).agg(F.min(F.struct("x", "r")).alias("best"))
    return best.select("field", F.col("best.x").alias("knocked_out_by"), F.col("best.r").alias("r"))


def greedy_knock_outs(cut: DataFrame) -> DataFrame:
    """``(field, knocked_out_by, r)``: fields taken in order, each falls if an earlier one that stands is its pair.

    A fallen field knocks nobody out, so no override list is needed: of every pair of the cut one field goes, and every
    field that goes has a partner that stays, the first of them by order. All fields whose earlier partners are decided
    are decided at once, so there are as many rounds as the longest chain of such waits; a round is joins on the pairs.
    """
    edges = stage(cut.where("x_ord < y_ord").select("x_ord", "x", "y_ord", "y", "r"), "knock-out-pairs")
    waiting, fallen = edges, None
    while not waiting.isEmpty():
        later = waiting.select(F.col("y_ord").alias("f")).distinct()
        stands = waiting.select(F.col("x_ord").alias("f")).distinct().join(later, "f", "left_anti")
        falls = stage(waiting.join(stands, waiting["x_ord"] == stands["f"], "left_semi").select(F.col("y_ord").alias("f")).distinct(), "falls")
        rest = waiting.join(falls, waiting["y_ord"] == falls["f"], "left_anti")
        rest = rest.join(falls.withColumnRenamed("f", "g"), F.col("x_ord") == F.col("g"), "left_anti")
        rest = stage(rest, "knock-out-pairs")
        if waiting is not edges:
            discard(waiting)
        waiting, fallen = rest, falls if fallen is None else fallen.union(falls)
    if fallen is None:
        return edges.select(F.col("y").alias("field"), F.col("x").alias("knocked_out_by"), "r").limit(0)
    gone = fallen.withColumnRenamed("f", "gone")
    decided = edges.join(gone, F.col("y_ord") == F.col("gone"), "left_semi").join(gone, F.col("x_ord") == F.col("gone"), "left_anti")
    best = decided.groupBy(F.col("y").alias("field")).agg(F.min(F.struct("x_ord", "x", "r")).alias("best"))
    return best.select("field", F.col("best.x").alias("knocked_out_by"), F.col("best.r").alias("r"))


def verdicts(catalog: DataFrame, out: DataFrame) -> DataFrame:
    """DROP for knocked-out fields of the catalog, KEEP for the rest."""
    word = F.when(F.col("r").isNotNull(), "DROP").otherwise("KEEP")
    return catalog.join(out, "field", "left").withColumn("verdict", word)


def overridden(table: DataFrame, drop: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """Final verdict: the drop list goes before the keep list, the keep list before the verdict."""
    field = F.col("field")
    final = F.when(field.isin(list(drop)), "DROP").when(field.isin(list(keep)), "KEEP").otherwise(F.col("verdict"))
    return table.withColumn("final_verdict", final)


def overridden_by(table: DataFrame, lists: DataFrame) -> DataFrame:
    """:func:`overridden` with the lists as a table ``(field, verdict, priority)``: the entry with the smallest priority
    decides, at equal priorities DROP before KEEP; fields without an entry keep their verdict."""
    first = lists.groupBy(F.col("field").alias("__field")).agg(F.min(F.struct("priority", "verdict"))["verdict"].alias("__listed"))
    final = F.coalesce("__listed", "verdict").alias("final_verdict")
    return table.join(first, F.col("field") == F.col("__field"), "left").select(*[F.col(f"`{c}`") for c in table.columns], final)


def target_relevance(target_pairs: DataFrame, target: str, dropped: DataFrame | None = None) -> DataFrame:
    """``(term, r, abs_r)`` of every surviving field against one target."""
    rows = target_pairs.where((F.col("y") == target) & (F.col("x") != target))
    if dropped is not None:
        rows = rows.join(dropped.select(F.col("field").alias("x")), "x", "left_anti")
    return rows.select(F.col("x").alias("term"), "r", F.abs("r").alias("abs_r"))
