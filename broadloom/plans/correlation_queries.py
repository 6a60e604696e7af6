"""Registered queries: correlation, knock-out, overrides and manifests over the order features."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadloom.operators import correlation, dictionary, encoding, joins, knockout, manifest, selectors
from broadloom.plans import features as ft, flows, presets, twin_sql as sql
from broadloom.plans.registry import query
from broadloom.session import shared_path, stage
from broadloom.sources import files

NUMBERS = ft.ORDER_NUMBERS
CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TARGETS = [f"TARGET_{c}" for c in CLASSES]
DROP = ["c_acctbal", "qty_sum"]
KEEP = ["price_sum", "net_sum"]
SOURCE = "features.order_features"
FLAGGED_SQL = f"SELECT *, {', '.join(f'''CASE WHEN o_orderpriority = '{c}' THEN 1 ELSE 0 END AS "TARGET_{c}"''' for c in CLASSES)} FROM ({sql.ORDER_FEATURES})"


def _pairs(spark, folder):
    return correlation.correlation_pairs(ft.order_features(spark, folder), NUMBERS)


def _catalog(spark):
    return spark.createDataFrame(list(enumerate(NUMBERS)), "ordinal int, field string")


def _verdicts(spark, folder):
    out = knockout.knock_outs(knockout.correlated(_pairs(spark, folder)))
    return knockout.verdicts(_catalog(spark), out)


def _final(spark, folder):
    return knockout.overridden(_verdicts(spark, folder), DROP, KEEP)


def _flagged(spark, folder):
    df = ft.order_features(spark, folder)
    flags = encoding.flag_columns("o_orderpriority", CLASSES)
    return df.select("*", *[c.alias(n) for n, c in flags.items()])


_PAIRS = sql.pairs(sql.ORDER_FEATURES, NUMBERS)
_VERDICTS = f"WITH {_PAIRS}, {sql.verdicts()}"
_FINAL = f"""{_VERDICTS}, final AS (
  SELECT *, CASE WHEN field IN ({sql.listed(DROP)}) THEN 'DROP'
                 WHEN field IN ({sql.listed(KEEP)}) THEN 'KEEP' ELSE verdict END AS final_verdict
  FROM verdicts)"""
_MANIFEST = f"""{_FINAL}, listed AS (
  SELECT row_number() OVER (ORDER BY part, ordinal) AS position, field, '{SOURCE}' AS source
  FROM (SELECT 0 AS part, 0 AS ordinal, 'o_orderkey' AS field
        UNION ALL SELECT 1, ordinal, field FROM final WHERE final_verdict = 'KEEP'))"""


@query("corr_knockout", f"{_VERDICTS} SELECT field, ordinal, knocked_out_by, round(r, 6) + 0.0 AS r, verdict FROM verdicts")
def corr_knockout(spark, folder):
    """Pairs at |r| >= .85 and, per field, the earlier field that knocks it out."""
    table = _verdicts(spark, folder)
    return table.select("field", "ordinal", "knocked_out_by", F.round("r", 6).alias("r"), "verdict")


@query("corr_pairs_full", f"WITH {_PAIRS} SELECT x, y, round(r, 6) + 0.0 AS r FROM pairs WHERE r IS NOT NULL")
def corr_pairs_full(spark, folder):
    """Lower triangle of the matrix in long form."""
    return correlation.known_pairs(_pairs(spark, folder)).select("x", "y", F.round("r", 6).alias("r"))


@query(
    "corr_matrix_long",
    f"""WITH {_PAIRS} SELECT x, y, round(r, 6) + 0.0 AS r FROM pairs
    UNION ALL SELECT y, x, round(r, 6) + 0.0 FROM pairs
    UNION ALL SELECT field, field, NULL FROM (SELECT DISTINCT field FROM cells)""",
)
def corr_matrix_long(spark, folder):
    """The whole matrix in long form, diagonal missing."""
    return correlation.both_ways(_pairs(spark, folder), NUMBERS).select("x", "y", F.round("r", 6).alias("r"))


@query("corr_pair_rows", f"WITH {_PAIRS} SELECT x, y, n FROM pairs")
def corr_pair_rows(spark, folder):
    """Rows each pair was computed on."""
    return _pairs(spark, folder).select("x", "y", "n")


_SKEWED = ["revenue", "shifted", "price", "cust", "prio", "squared"]
_SKEWED_SQL = """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
    WHEN o_orderstatus = 'P' THEN o_totalprice * 1e6 ELSE o_totalprice END AS revenue,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice + 1e7 END AS shifted, o_totalprice AS price,
  CAST(o_custkey AS DOUBLE) AS cust, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio,
  o_totalprice * o_totalprice AS squared FROM orders"""


@query(
    "corr_skewed_gaps",
    f"WITH {sql.pairs(_SKEWED_SQL, _SKEWED, 'o_orderkey')} SELECT x, y, round(r, 6) + 0.0 AS r, n FROM pairs",
)
def corr_skewed_gaps(spark, folder):
    """A revenue with outliers and gaps, whose outliers have no partner in the shifted column."""
    urgent, open_ = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P"
    price = F.col("o_totalprice")
    orders = ft.table(spark, folder, "orders").select(
        F.when(urgent, None).when(open_, price * 1e6).otherwise(price).alias("revenue"),
        F.when(~open_, price + 1e7).alias("shifted"),
        price.alias("price"),
        F.col("o_custkey").cast("double").alias("cust"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"),
        (price * price).alias("squared"),
    )
    return correlation.correlation_pairs(orders, _SKEWED).select("x", "y", F.round("r", 6).alias("r"), "n")


_STRICT_NUMBERS = [*NUMBERS, "price_scaled", "price_negated", "qty_nearly"]
_STRICT_SQL = f"""SELECT *, 2 * price_sum + 1 AS price_scaled, -price_sum AS price_negated,
  qty_sum + ret_cnt / 4.0 AS qty_nearly FROM ({sql.ORDER_FEATURES})"""


@query(
    "corr_strict_099",
    f"""WITH {sql.pairs(_STRICT_SQL, _STRICT_NUMBERS)}, {sql.verdicts(presets.STRENGTH, presets.STRICT_SIGNED, _STRICT_NUMBERS)}
    SELECT field, knocked_out_by, round(r, 6) + 0.0 AS r FROM verdicts WHERE verdict = 'DROP'""",
)
def corr_strict_099(spark, folder):
    """Near duplicates only: r itself at .99, so a negated copy stays."""
    df = ft.order_features(spark, folder).select(
        "*",
        (2 * F.col("price_sum") + 1).alias("price_scaled"),
        (-F.col("price_sum")).alias("price_negated"),
        (F.col("qty_sum") + F.col("ret_cnt") / 4).alias("qty_nearly"),
    )
    pairs = correlation.correlation_pairs(df, _STRICT_NUMBERS)
    catalog = selectors.field_catalog(df, *_STRICT_NUMBERS).select("ordinal", "field")
    out = knockout.knock_outs(knockout.correlated(pairs, presets.STRENGTH, presets.STRICT_SIGNED))
    rows = knockout.verdicts(catalog, out).where(F.col("verdict") == "DROP")
    return rows.select("field", "knocked_out_by", F.round("r", 6).alias("r"))


_TARGET_PAIRS = sql.target_pairs(FLAGGED_SQL, NUMBERS, TARGETS)
_WITH_TARGET = [*NUMBERS, "urgent"]


@query(
    "corr_to_target",
    f"""WITH {sql.pairs(f"SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent FROM ({sql.ORDER_FEATURES})", _WITH_TARGET)},
    {sql.verdicts()}
    SELECT x AS term, round(r, 6) + 0.0 AS r, round(abs(r), 6) AS abs_r FROM pairs
    WHERE y = 'urgent' AND x NOT IN (SELECT field FROM verdicts WHERE verdict = 'DROP')""",
)
def corr_to_target(spark, folder):
    """Relevance of the surviving fields for one target flag: drop list and relevance from one matrix."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    df = ft.order_features(spark, folder).withColumn("urgent", urgent)
    pairs = stage(correlation.correlation_pairs(df, _WITH_TARGET), "pairs")
    out = knockout.knock_outs(knockout.correlated(pairs.where(F.col("y") != "urgent")))
    dropped = knockout.verdicts(_catalog(spark), out).where(F.col("verdict") == "DROP")
    rows = knockout.target_relevance(pairs, "urgent", dropped)
    return rows.select("term", F.round("r", 6).alias("r"), F.round("abs_r", 6).alias("abs_r"))


@query(
    "corr_multi_target",
    f"WITH {_TARGET_PAIRS} SELECT x AS term, "
    + ", ".join(f"round(max(r) FILTER (WHERE y = '{t}'), 6) + 0.0 AS \"{t}\"" for t in TARGETS)
    + " FROM pairs GROUP BY x",
)
def corr_multi_target(spark, folder):
    """Field-by-target table over all target flags; only these pairs are computed."""
    pairs = correlation.correlation_pairs(_flagged(spark, folder), NUMBERS, TARGETS)
    table = correlation.focus(pairs, TARGETS)
    return table.select("term", *[F.round(F.col(f"`{t}`"), 6).alias(t) for t in TARGETS])


@query("verdict_override", f"{_FINAL} SELECT field, verdict, final_verdict FROM final")
def verdict_override(spark, folder):
    """Drop list before keep list before the computed verdict."""
    return _final(spark, folder).select("field", "verdict", "final_verdict")


@query(
    "manifest_chunks",
    f"""{_FINAL} SELECT line, string_agg('''' || field || '''', ', ' ORDER BY field) AS code
    FROM (SELECT field, CAST(row_number() OVER (ORDER BY field) // 4 AS INTEGER) AS line
          FROM final WHERE final_verdict = 'KEEP') GROUP BY line""",
)
def manifest_chunks(spark, folder):
    """Kept fields, sorted and quoted, four to a line (the first line one short)."""
    return manifest.chunked_list(_final(spark, folder).where("final_verdict = 'KEEP'"), per_line=4)


@query(
    "manifest_text",
    f"""{_FINAL} SELECT string_agg(code, ',' || chr(10) ORDER BY line) AS code FROM (
      SELECT line, string_agg('''' || field || '''', ', ' ORDER BY field) AS code
      FROM (SELECT field, row_number() OVER (ORDER BY field) // 4 AS line
            FROM final WHERE final_verdict = 'KEEP') GROUP BY line)""",
)
def manifest_text(spark, folder):
    lines = manifest.chunked_list(_final(spark, folder).where("final_verdict = 'KEEP'"), per_line=4)
    return manifest.joined_lines(lines)


@query(
    "manifest_vector",
    f"""{_VERDICTS} SELECT 'c(' || string_agg('''' || field || '''', ',' ORDER BY ordinal) || ')' AS value
    FROM verdicts WHERE verdict = 'DROP'""",
)
def manifest_vector(spark, folder):
    """The drop list as one quoted vector."""
    return manifest.vector_text(_verdicts(spark, folder).where("verdict = 'DROP'"))


def _manifest(spark, folder):
    ids = spark.createDataFrame([(0, "o_orderkey")], "ordinal int, field string")
    return manifest.manifest(ids, _final(spark, folder).where("final_verdict = 'KEEP'"), SOURCE)


@query("manifest_table", f"{_MANIFEST} SELECT CAST(position AS INTEGER) AS position, field, source FROM listed")
def manifest_table(spark, folder):
    return _manifest(spark, folder)


@query(
    "manifest_sql",
    f"""{_MANIFEST} SELECT 'SELECT ' || chr(10) || string_agg(field, ',' || chr(10) ORDER BY position)
    || chr(10) || 'FROM ' || min(source) AS statement FROM listed""",
)
def manifest_sql(spark, folder):
    return manifest.select_statement(_manifest(spark, folder))


@query(
    "text_roundtrip",
    f"""{_MANIFEST} SELECT unnest(string_split('SELECT ' || chr(10) || string_agg(field, ',' || chr(10) ORDER BY position)
      || chr(10) || 'FROM ' || min(source), chr(10))) AS value FROM listed""",
)
def text_roundtrip(spark, folder):
    """The statement written to a text file in the shared folder, read back line by line."""
    path = shared_path(spark, "statement")
    files.write_text(manifest.select_statement(_manifest(spark, folder)), path)
    return files.read_text(spark, path)


@query(
    "correlation_cut_flow",
    f"""{_MANIFEST} SELECT CAST(l.position AS INTEGER) AS position, l.field, l.source,
      f.verdict, round(f.r, 6) + 0.0 AS r
    FROM listed l LEFT JOIN final f ON l.field = f.field""",
)
def correlation_cut_flow(spark, folder):
    """The whole flow from the feature table to the manifest, with what was overridden."""
    cut = flows.correlation_cut(
        ft.order_features(spark, folder), selectors.starts_with("o_orderk"), SOURCE, drop=DROP, keep=KEEP
    )
    reasons = cut.verdicts.select("field", "verdict", F.round("r", 6).alias("r"))
    return cut.manifest.join(reasons, "field", "left")


_SURVIVORS = [n for n in NUMBERS if n != "net_sum"]
_MONEY = ["o_totalprice", "c_acctbal", "qty_sum", "price_sum", "disc_sum", "tax_sum", "qty_max"]


@query(
    "manifest_projection",
    "SELECT o_orderkey, o_orderpriority, "
    + ", ".join(f"round({n}, 4) AS {n}" if n in _MONEY else n for n in _SURVIVORS)
    + f" FROM ({sql.ORDER_FEATURES})",
)
def manifest_projection(spark, folder):
    """A final field list, written and read back as CSV, applied to the feature table, and the class
    label joined back to it by key. At r >= .99 only the net total falls."""
    df = stage(ft.order_features(spark, folder), "features")
    numbers = selectors.without(df, "o_orderpriority")
    out = knockout.knock_outs(knockout.correlated(correlation.correlation_pairs(numbers, NUMBERS), presets.STRENGTH, presets.STRICT_SIGNED))
    path = shared_path(spark, "elimination")
    files.write_csv(knockout.verdicts(_catalog(spark), out), path)
    listed = files.read_csv(spark, path, "field string, ordinal int, knocked_out_by string, r double, verdict string")
    kept = selectors.column_values(listed.where("verdict = 'KEEP'").orderBy("ordinal"), "field")
    features = selectors.pick(numbers, "o_orderkey", selectors.all_of(kept))
    labelled = joins.natural_join(features, df.select("o_orderkey", "o_orderpriority"), "left")
    final = selectors.pick(labelled, "o_orderkey", "o_orderpriority", selectors.everything())
    return final.select(*[F.round(n, 4).alias(n) if n in _MONEY else n for n in final.columns])


@query(
    "label_index",
    """SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders""",
)
def label_index(spark, folder):
    """A class as a number, in name order."""
    orders = ft.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    numbered = dictionary.with_level(orders, "o_orderpriority", dictionary.levels(orders, ["o_orderpriority"]), "label")
    return numbered.withColumn("label", F.col("label").cast("double"))


@query(
    "wide_corr_knockout",
    f"""WITH {sql.wide_pairs()}, {sql.verdicts(0.85, None, ft.WIDE_FIELDS)}
    SELECT field, ordinal, knocked_out_by, round(r, 6) + 0.0 AS r, verdict FROM verdicts""",
)
def wide_corr_knockout(spark, folder):
    """The knock-out over a wide, gappy table: 168 columns, 14,028 pairs, each on its own rows."""
    pairs = correlation.correlation_pairs(ft.part_features(spark, folder), ft.WIDE_FIELDS)
    catalog = spark.createDataFrame(list(enumerate(ft.WIDE_FIELDS)), "ordinal int, field string")
    table = knockout.verdicts(catalog, knockout.knock_outs(knockout.correlated(pairs)))
    return table.select("field", "ordinal", "knocked_out_by", F.round("r", 6).alias("r"), "verdict")


@query("wide_corr_pairs", f"WITH {sql.wide_pairs()} SELECT x, y, round(r, 6) + 0.0 AS r, n FROM pairs")
def wide_corr_pairs(spark, folder):
    """Every pair of the wide table with its correlation and the rows behind it."""
    pairs = correlation.correlation_pairs(ft.part_features(spark, folder), ft.WIDE_FIELDS)
    return pairs.where("n > 0").select("x", "y", F.round("r", 6).alias("r"), "n")


@query("wide_corr_tiles", f"WITH {sql.wide_pairs()} SELECT x, y, round(r, 6) + 0.0 AS r, n FROM pairs")
def wide_corr_tiles(spark, folder):
    """The pairs of the wide table by tiles of 50 columns: 10 pairs of tiles, each reading its own columns."""
    pairs = correlation.correlation_pairs(ft.part_features(spark, folder), ft.WIDE_FIELDS, strategy="gram", tile=50)
    return pairs.where("n > 0").select("x", "y", F.round("r", 6).alias("r"), "n")


_GREEDY = 0.4


@query(
    "wide_corr_greedy",
    f"""WITH RECURSIVE {sql.wide_pairs()}, cut AS (SELECT * FROM pairs WHERE abs(round(r, 9)) >= {_GREEDY}),
    g(ord, kept) AS (
      SELECT -1, CAST([] AS INTEGER[])
      UNION ALL
      SELECT ord + 1, CASE WHEN EXISTS (SELECT 1 FROM cut c WHERE c.y_ord = ord + 1 AND list_contains(kept, c.x_ord)) THEN kept
        ELSE list_append(kept, ord + 1) END
      FROM g WHERE ord + 1 < {len(ft.WIDE_FIELDS)}),
    standing AS (SELECT unnest(kept) AS x_ord FROM g WHERE ord = {len(ft.WIDE_FIELDS) - 1})
    SELECT y AS field, arg_min(x, c.x_ord) AS knocked_out_by, round(arg_min(r, c.x_ord), 6) + 0.0 AS r
    FROM cut c JOIN standing s ON s.x_ord = c.x_ord WHERE c.y_ord NOT IN (SELECT x_ord FROM standing) GROUP BY y""",
)
def wide_corr_greedy(spark, folder):
    """The greedy knock-out over the wide table: what falls knocks nothing out."""
    pairs = stage(correlation.correlation_pairs(ft.part_features(spark, folder), ft.WIDE_FIELDS), "pairs")
    cut = pairs.where(F.abs(F.round("r", 9)) >= _GREEDY)
    return knockout.greedy_knock_outs(cut).select("field", "knocked_out_by", F.round("r", 6).alias("r"))


@query(
    "verdict_override_table",
    f"""WITH {sql.pairs(sql.ORDER_FEATURES, NUMBERS)}, {sql.verdicts(0.85)},
    named AS (SELECT n_name, min(n_nationkey) AS priority FROM nation GROUP BY n_name),
    lists AS (SELECT v.field, CASE WHEN priority % 2 = 0 THEN 'DROP' ELSE 'KEEP' END AS verdict, priority
      FROM verdicts v JOIN named ON priority % {len(NUMBERS)} = v.ordinal),
    first AS (SELECT field, arg_min(verdict, (priority, verdict)) AS listed FROM lists GROUP BY field)
    SELECT v.field, v.verdict, coalesce(listed, v.verdict) AS final_verdict FROM verdicts v LEFT JOIN first USING (field)""",
)
def verdict_override_table(spark, folder):
    """Overrides as a table with priorities, several entries for a field."""
    df = ft.order_features(spark, folder)
    out = knockout.knock_outs(knockout.correlated(correlation.correlation_pairs(df, NUMBERS)))
    judged = stage(knockout.verdicts(_catalog(spark), out), "verdicts")
    nation = ft.table(spark, folder, "nation").groupBy("n_name").agg(F.min("n_nationkey").alias("priority"))
    listed = F.when(F.col("priority") % 2 == 0, "DROP").otherwise("KEEP").alias("verdict")
    lists = judged.select("field", "ordinal").join(nation, F.col("priority") % len(NUMBERS) == F.col("ordinal")).select("field", listed, "priority")
    return knockout.overridden_by(judged, lists).select("field", "verdict", "final_verdict")


@query(
    "wide_manifest_chunks",
    f"""WITH {sql.wide_pairs()}, {sql.verdicts(presets.STRENGTH, None, ft.WIDE_FIELDS)}
    SELECT line, string_agg('''' || field || '''', ', ' ORDER BY field) AS code
    FROM (SELECT field, CAST(row_number() OVER (ORDER BY field) // {presets.NAMES_PER_LINE} AS INTEGER) AS line FROM verdicts WHERE verdict = 'KEEP')
    GROUP BY line""",
)
def wide_manifest_chunks(spark, folder):
    """The kept fields of the wide table, quoted, by the preset number of names a line."""
    pairs = correlation.correlation_pairs(ft.part_features(spark, folder), ft.WIDE_FIELDS)
    catalog = spark.createDataFrame(list(enumerate(ft.WIDE_FIELDS)), "ordinal int, field string")
    kept = knockout.verdicts(catalog, knockout.knock_outs(knockout.correlated(pairs))).where("verdict = 'KEEP'")
    return manifest.chunked_list(kept, per_line=presets.NAMES_PER_LINE)
