"""Whole flows: correlation cut to manifest, feature preparation, refresh and chunked selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from broadloom.functions import cells
from broadloom.operators import binning, cleaning, correlation, encoding, joins, knockout, manifest, ranking
from broadloom.operators.forests import Forest, all_relevant, chunked_relevance
from broadloom.operators.importance import first_listed
from broadloom.operators.selectors import (
    Selector, all_of, any_of, col, column_values, contains, ends_with, field_catalog,
    minus_names, numeric, pick, starts_with, text, without,
)
from broadloom.plans import presets
from broadloom.session import stage


@dataclass
class CorrelationCut:
    """Pairs (staged), verdicts per field, the manifest of kept columns and its statement."""

    pairs: DataFrame
    verdicts: DataFrame
    manifest: DataFrame
    statement: DataFrame


def correlation_cut(
    df: DataFrame,
    ids: Selector,
    source: str,
    strength: float = presets.STRENGTH,
    signed: float | None = None,
    drop: Iterable[str] = (),
    keep: Iterable[str] = (),
    scope: Selector | None = None,
) -> CorrelationCut:
    """Correlate all numeric non-id columns, knock out, override, and list the columns to keep.

    ``scope`` is the catalog that receives verdicts, by default the correlated columns; fields outside
    the correlation are kept. The pairs are staged, so the data is scanned once however many of the
    results are used.
    """
    id_names = ids.names(df)
    fields = (numeric() & ~any_of(id_names)).names(df)
    pairs = stage(correlation.correlation_pairs(df, fields), "pairs")
    catalog = field_catalog(df, *([scope] if scope else fields)).select("ordinal", "field")
    out = knockout.knock_outs(knockout.correlated(pairs, strength, signed))
    final = knockout.overridden(knockout.verdicts(catalog, out), drop, keep)
    kept = final.where(F.col("final_verdict") == "KEEP")
    listed = manifest.manifest(field_catalog(df, *id_names).select("ordinal", "field"), kept, source)
    return CorrelationCut(pairs, final, listed, manifest.select_statement(listed))


def project(df: DataFrame, listed: DataFrame) -> DataFrame:
    """The table with the manifest's columns, in manifest order."""
    return pick(df, all_of(column_values(listed.orderBy("position"), "field")))


def master_table(
    df: DataFrame,
    key: str,
    target: str,
    rules: Iterable[binning.BinRule],
    merged: Mapping[str, Iterable[str]] | None = None,
    dropped: Iterable[str] = (),
) -> DataFrame:
    """Target flags, bins and one-hot columns for the text fields, and typed fills: one numeric table.

    The flags and codes are columns of the same projection instead of separate tables joined back by
    key, so beyond finding the levels the data is read once and not exchanged.
    """
    df = without(df, all_of(dropped))
    for label, members in (merged or {}).items():
        df = df.withColumn(target, cells.merged_class(col(target), members, label))
    rules = list(rules)
    coded = list(dict.fromkeys([*(r.field for r in rules), *minus_names(text().names(df), [key, target])]))
    binned = binning.bin_fields(df, rules)
    words = cleaning.across(binned, text() & ~any_of([key, target]), lambda c: F.coalesce(c, F.lit(cells.MISSING_TEXT)))
    levels = encoding.levels_of(words, [target, *coded])
    flags = encoding.flag_columns(target, levels[target])
    rest = [col(n) for n in minus_names(words.columns, [key, target])]
    flagged = words.select(col(key), *[c.alias(n) for n, c in flags.items()], *rest)
    return cleaning.fill_missing(encoding.one_hot(flagged, coded, levels))


def refreshed_table(
    df: DataFrame,
    key: str,
    updates: DataFrame,
    members: DataFrame,
    member_flag: str,
    shared: Selector,
    total: str,
    front: Sequence[str] = (),
) -> DataFrame:
    """Replace stale columns by key, flag listed keys, order the columns and turn amounts into shares.

    All joins use the key as it is stored, so tables partitioned by it are not exchanged again; it
    becomes text at the end.
    """
    flagged = joins.membership_flag(*joins.same_key(df, members, key), key, member_flag)
    fresh = joins.key_as_text(joins.replace_columns(flagged, updates, key), key)
    ordered = pick(fresh, key, *front, member_flag, all_of(sorted(fresh.columns)))
    return cleaning.shares(ordered, shared, total)


def share_columns() -> Selector:
    """The amounts that become shares, by the naming convention of the marketing tables."""
    return ~starts_with("ALL_WON_DTL_REV") & contains("WON_DTL") & contains("COMP") & ~ends_with("_FLG")


def encoded_codes(
    df: DataFrame, rules: Iterable[binning.BinRule], counts: Iterable[str] = (), most: int = presets.LEVELS_PREPARED
) -> DataFrame:
    """Bin codes and counts, fill and clean, and one-hot the text columns with few levels."""
    binned = cleaning.count_bins(binning.bin_fields(df, rules), counts)
    return encoding.dummify(cleaning.clean_text(cleaning.fill_missing(binned)), most)


def trend_features(trends: DataFrame, key: str, groups: Mapping[str, Selector], most: int = presets.LEVELS_TRENDS):
    """Trend codes with a pattern word per group of columns, one-hot encoded.

    Codes and words are closed sets, so their columns do not depend on what occurs; other text columns get those
    of their levels.
    """
    codes = cleaning.sentinels_to_text(cleaning.fill_missing(trends), ends_with("_TREND_CATG"))
    patterns = [cells.trend_pattern([col(n) for n in g.names(codes)]).alias(name) for name, g in groups.items()]
    levels = {n: list(cells.TREND_CODES) for n in ends_with("_TREND_CATG").names(codes)}
    levels |= {name: list(cells.TREND_WORDS) for name in groups}
    flags = encoding.one_hot(codes.select("*", *patterns), list(levels), levels, clean=False)
    return encoding.dummify(flags, most, text() & ~any_of([key]))


def ranked_selection(
    df: DataFrame,
    key: str,
    targets: Sequence[str],
    fields: Sequence[str],
    chunk_size: int = presets.CHUNK_SIZE,
    max_runs: int = presets.CHUNK_RUNS,
    best: int = presets.BEST_PER_TARGET,
    forest: Forest = Forest(),
    rules: Iterable[tuple[str, str, str]] = presets.TAXONOMY,
) -> DataFrame:
    """Field taxonomy, chunks by type, forests per target and chunk, and the combined best list."""
    typed = ranking.taxonomy(field_catalog(df, *fields).select("ordinal", "field"), rules)
    chunked = ranking.numbered_chunks(typed, ["type", "ordinal"], chunk_size)
    chunks: dict[int, list[str]] = {}
    for row in sorted(chunked.collect(), key=lambda r: (r["type"], r["ordinal"])):  # one row per column
        chunks.setdefault(row["chunk"], []).append(row["field"])
    stats = chunked_relevance(df, key, targets, chunks, max_runs, forest)
    return first_listed(stats.join(typed.select("field", "type"), "field", "left"), targets, best)


def final_selection(
    df: DataFrame,
    key: str,
    target: str,
    listed: DataFrame,
    merged: Mapping[str, Iterable[str]] | None = None,
    rows: Column | None = None,
    max_runs: int = presets.FINAL_RUNS,
    forest: Forest = Forest(classes=True),
    rules: Iterable[tuple[str, str, str]] = presets.TAXONOMY,
) -> DataFrame:
    """The last step of a selection: ``(field, type, decision, mean_imp, …, norm_hits)``, best median first.

    ``listed`` is a manifest (``position, field``): its columns are the candidates, key and target left out. ``merged``
    joins classes of the target, ``rows`` keeps the rows of one group; the forests see what remains. The statistics come
    with the taxonomy of the fields.
    """
    kept = minus_names(column_values(listed.orderBy("position"), "field"), [key, target])
    df = pick(df if rows is None else df.where(rows), key, target, all_of(kept))
    for label, members in (merged or {}).items():
        df = df.withColumn(target, cells.merged_class(col(target), members, label))
    found = all_relevant(df, key, target, kept, max_runs, forest).fields
    typed = ranking.taxonomy(field_catalog(df, *kept).select("ordinal", "field"), rules).select("field", "type")
    return found.join(typed, "field", "left").orderBy(F.desc_nulls_last("median_imp"), "field")
