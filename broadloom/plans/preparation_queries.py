"""Registered queries: selection of columns, joins, cleaning, binning, encoding, reshaping, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadloom.functions import cells
from broadloom.operators import binning, cleaning, dictionary, encoding, joins, profiles, ranking, selectors as s
from broadloom.operators.binning import KEEP, BinRule
from broadloom.plans import features as ft, flows, twin_sql as sql
from broadloom.plans.registry import query
from broadloom.session import shared_path, stage
from broadloom.sources import files

CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
STATUSES = ["F", "O", "P"]
MONEY = ["o_totalprice", "c_acctbal", "price_sum", "disc_sum", "tax_sum", "net_sum"]


def _rounded(df, digits=6):
    """Doubles rounded, so that sums compare whatever their order of addition."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(
        *[F.round(s.col(n), digits).alias(n) if kinds[n] == "double" else s.col(n) for n in df.columns]
    )


def _flag(c, value, name):
    return f"CASE WHEN {c} = '{value}' THEN 1 ELSE 0 END AS \"{name}\""


# --- columns by name, pattern and type ---


@query(
    "select_by_pattern",
    f"""SELECT o_orderkey, {sql.rounded(["price_sum", "net_sum", "qty_sum"], 4)}, ret_flg
    FROM ({sql.ORDER_FEATURES})""",
)
def select_by_pattern(spark, folder):
    """Key and flag by suffix, sums by regular expression; the patterns ignore case."""
    df = ft.order_features(spark, folder)
    picked = s.pick(df, "o_orderkey", s.matches("^(PRICE|net|qty)_sum$"), s.ends_with("_FLG") & ~s.starts_with("HAS"))
    return _rounded(picked, 4)


@query(
    "select_algebra",
    f"""SELECT o_orderkey, o_orderpriority, round(o_totalprice, 4) AS o_totalprice, c_mktsegment
    FROM ({sql.ORDER_FEATURES})""",
)
def select_algebra(spark, folder):
    """Union keeps the first operand's order; intersection; complement; unknown names tolerated."""
    chosen = (s.starts_with("o_") & ~s.contains("status")) | (s.text() & s.any_of(["c_mktsegment", "no_such_column"]))
    return _rounded(s.pick(ft.order_features(spark, folder), chosen), 4)


@query(
    "drop_list_except",
    f"""SELECT o_orderkey, o_orderpriority, o_orderstatus, c_mktsegment, n_name, r_name, has_line_flg, ret_cnt, open_cnt
    FROM ({sql.ORDER_FEATURES})""",
)
def drop_list_except(spark, folder):
    """A drop list with the fields that match a pattern forced back, at the end."""
    df = s.without(ft.order_features(spark, folder), s.contains("_sum"), "qty_max", "ret_flg")
    return s.without_except(df, ["o_totalprice", "c_acctbal", "line_cnt", "ret_cnt", "open_cnt", "gone"], "(ret|open)_")


@query(
    "reordered_columns",
    """SELECT o_orderkey, o_custkey AS customer, o_orderpriority, o_orderstatus, o_totalprice FROM orders""",
)
def reordered_columns(spark, folder):
    """Rename, alphabetical order, key moved to the front."""
    df = s.renamed(ft.table(spark, folder, "orders"), {"customer": "o_custkey"})
    return s.pick(s.without(s.alphabetical(df), "o_orderdate"), "o_orderkey", s.everything())


_WORDS = ["o_orderpriority", "o_orderstatus", "c_mktsegment", "n_name", "r_name"]


@query(
    "field_catalog_levels",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{f}')" for i, f in enumerate(_WORDS))
    + ") c(ordinal, field) JOIN ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, 'string' AS type, count(DISTINCT {f}) AS levels FROM ({sql.ORDER_FEATURES})"
        for f in _WORDS
    )
    + ") USING (field)",
)
def field_catalog_levels(spark, folder):
    """The schema as a table, with the number of levels of its text fields."""
    df = ft.order_features(spark, folder)
    words = s.text().names(df)
    return s.field_catalog(df, *words).join(ranking.cardinality(df, words), "field")


# --- joins ---


@query(
    "natural_join",
    """SELECT o_custkey AS c_custkey, o_orderkey, o_orderpriority, c_mktsegment, c_nationkey
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def natural_join(spark, folder):
    orders = ft.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority"
    )
    return joins.natural_join(orders, ft.table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"))


_SEGMENT_NULLED = "nullif(c_mktsegment, 'BUILDING')"


@query(
    "null_safe_join",
    f"""WITH c AS (SELECT c_custkey, {_SEGMENT_NULLED} AS segment FROM customer),
    t AS (SELECT segment, count(*) AS customers FROM c GROUP BY segment)
    SELECT c.c_custkey, c.segment, t.customers FROM c JOIN t ON c.segment IS NOT DISTINCT FROM t.segment""",
)
def null_safe_join(spark, folder):
    """Missing keys match each other."""
    left = ft.table(spark, folder, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment")
    )
    totals = left.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    return joins.natural_join(left, totals, null_safe=True)


@query(
    "suffix_join",
    """WITH f AS (SELECT o_custkey, count(*) AS cnt, round(sum(o_totalprice), 4) AS rev FROM orders
                  WHERE o_orderstatus = 'F' GROUP BY o_custkey),
    p AS (SELECT o_custkey, count(*) AS cnt, round(sum(o_totalprice), 4) AS rev FROM orders
          WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
    SELECT f.o_custkey, f.cnt AS cnt_x, f.rev AS rev_x, p.cnt AS cnt_y, p.rev AS rev_y
    FROM f JOIN p ON f.o_custkey = p.o_custkey""",
)
def suffix_join(spark, folder):
    """Join by key; other shared names get suffixes."""

    def totals(which):
        rows = ft.table(spark, folder, "orders").where(which)
        return rows.groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("cnt"), F.round(F.sum("o_totalprice"), 4).alias("rev")
        )

    return joins.keyed_join(totals(F.col("o_orderstatus") == "F"), totals(F.col("o_orderstatus") != "F"), ["o_custkey"])


@query(
    "lookup_join",
    """SELECT n.n_name, n.n_nationkey AS nation, t.suppliers, t.suppliers_bal
    FROM nation n LEFT JOIN (
      SELECT s_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 4) AS suppliers_bal
      FROM supplier GROUP BY s_nationkey) t ON n.n_nationkey = t.s_nationkey""",
)
def lookup_join(spark, folder):
    """Left join where the key has another name on the right."""
    totals = ft.table(spark, folder, "supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 4).alias("suppliers_bal")
    )
    nation = ft.table(spark, folder, "nation").select("n_name", F.col("n_nationkey").alias("nation"))
    return joins.lookup_join(nation, totals, "nation", "s_nationkey")


_LAGGED = """SELECT o_custkey AS c_custkey, sum(o_totalprice) AS all_rev_sum,
  count_if(o_orderstatus = 'F') AS lagged_cnt FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey"""


def _lagged(spark, folder):
    early = ft.table(spark, folder, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return early.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("all_rev_sum"), F.count_if(F.col("o_orderstatus") == "F").alias("lagged_cnt")
    )


@query(
    "replace_columns",
    f"""SELECT CAST(c.c_custkey AS VARCHAR) AS c_custkey, c.c_mktsegment, c.all_order_cnt,
      round(l.all_rev_sum, 4) AS all_rev_sum, CAST(l.lagged_cnt AS BIGINT) AS lagged_cnt
    FROM ({sql.CUSTOMER_FEATURES}) c LEFT JOIN ({_LAGGED}) l ON c.c_custkey = l.c_custkey""",
)
def replace_columns(spark, folder):
    """Totals replaced by their lagged versions, keys compared as text."""
    base = ft.customer_features(spark, folder).select("c_custkey", "c_mktsegment", "all_order_cnt", "all_rev_sum")
    lagged = joins.key_as_text(_lagged(spark, folder), "c_custkey")
    return _rounded(joins.replace_columns(base, lagged, "c_custkey"), 4)


@query(
    "membership_flag",
    """SELECT c_custkey, c_mktsegment,
      CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 1 ELSE 0 END AS open_flg
    FROM customer""",
)
def membership_flag(spark, folder):
    pending = ft.table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    customers = ft.table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return joins.membership_flag(customers, pending, "c_custkey", "open_flg")


@query(
    "dictionary_semi",
    """SELECT p_partkey, p_brand, p_type FROM part
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)""",
)
def dictionary_semi(spark, folder):
    """Entries of a dictionary that occur elsewhere."""
    used = ft.table(spark, folder, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    return joins.restrict(ft.table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), used, "p_partkey", "l_partkey")


@query(
    "filter_null_rules",
    """SELECT c_custkey, segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)
    WHERE segment IS NULL OR segment NOT IN ('FURNITURE', 'MACHINERY')""",
)
def filter_null_rules(spark, folder):
    """The complement of a membership test keeps missing values."""
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment")
    rows = ft.table(spark, folder, "customer").select("c_custkey", segment)
    return rows.where(cells.not_in(F.col("segment"), ["FURNITURE", "MACHINERY"]))


# --- cleaning ---


def _filled_sql(name, kind):
    if kind == "text":
        return f"coalesce({name}, 'NULL') AS {name}"
    return f"coalesce({name}, -1) AS {name}" if kind == "count" else f"round(coalesce({name}, -1), 4) AS {name}"


@query(
    "fill_typed",
    "SELECT o_orderkey, "
    + ", ".join(
        _filled_sql(n, k)
        for n, k in [("status", "text"), ("line_cnt", "count"), ("qty_sum", "money"), ("net_sum", "money"), ("ret_cnt", "count")]
    )
    + f" FROM (SELECT *, nullif(o_orderstatus, 'P') AS status FROM ({sql.ORDER_FEATURES}))",
)
def fill_typed(spark, folder):
    """Missing numbers become -1, missing text becomes NULL."""
    df = ft.order_features(spark, folder).select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        "line_cnt", "qty_sum", "net_sum", "ret_cnt",
    )
    return _rounded(cleaning.fill_missing(df), 4)


@query(
    "sentinel_to_text",
    f"""SELECT o_orderkey,
      CASE WHEN line_cnt IS NULL THEN 'NULL' ELSE CAST(line_cnt AS VARCHAR) END AS line_cnt,
      CASE WHEN qty_sum IS NULL THEN 'NULL' ELSE CAST(CAST(qty_sum AS BIGINT) AS VARCHAR) END AS qty_sum
    FROM ({sql.ORDER_FEATURES})""",
)
def sentinel_to_text(spark, folder):
    """Filled numbers as text with the sentinel spelled out."""
    filled = cleaning.fill_missing(ft.order_features(spark, folder).select("o_orderkey", "line_cnt", "qty_sum"))
    return cleaning.sentinels_to_text(filled, ~s.any_of(["o_orderkey"]))


@query(
    "clean_names",
    """SELECT p_partkey, upper(replace(p_name, ' ', '_')) AS p_name, upper(replace(p_brand, ' ', '_')) AS p_brand,
      upper(replace(p_type, ' ', '_')) AS p_type, p_size FROM part""",
)
def clean_names(spark, folder):
    df = ft.table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return cleaning.clean_text(df)


@query(
    "share_of_total",
    f"""SELECT c_custkey, round(all_rev_sum, 4) AS all_rev_sum, """
    + ", ".join(f"round(coalesce({p} / nullif(all_rev_sum, 0), 0), 6) AS {p}" for p in ["p1_rev_sum", "p2_rev_sum", "p3_rev_sum"])
    + f" FROM ({sql.CUSTOMER_FEATURES})",
)
def share_of_total(spark, folder):
    """Revenue per priority as a share of all revenue; missing and zero totals give 0."""
    df = ft.customer_features(spark, folder).select("c_custkey", "all_rev_sum", "p1_rev_sum", "p2_rev_sum", "p3_rev_sum")
    shared = cleaning.shares(df, s.contains("_rev_sum") & ~s.starts_with("all_"), "all_rev_sum")
    return shared.select("c_custkey", F.round("all_rev_sum", 4).alias("all_rev_sum"),
                         *[F.round(n, 6).alias(n) for n in ("p1_rev_sum", "p2_rev_sum", "p3_rev_sum")])


@query(
    "flag_repair",
    f"""SELECT c_custkey, CASE WHEN f_flg = 0 AND p_flg = 1 THEN 1 ELSE 0 END AS f_flg
    FROM ({sql.CUSTOMER_FEATURES})""",
)
def flag_repair(spark, folder):
    df = ft.customer_features(spark, folder)
    return df.select("c_custkey", cells.repaired_flag(F.col("f_flg"), F.col("p_flg")).alias("f_flg"))


@query(
    "text_flag",
    """SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status,
      CASE WHEN nullif(o_orderstatus, 'F') = 'P' THEN 1 ELSE 0 END AS pending FROM orders""",
)
def text_flag(spark, folder):
    df = ft.table(spark, folder, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status")
    )
    return df.withColumn("pending", cells.text_flag(F.col("status"), "P"))


# --- binning ---

_SEGMENT_RULE = BinRule("segment", {"BIN_A": ["AUTOMOBILE", "MACHINERY"], "BIN_B": ["BUILDING"]})
_REGION_RULE = BinRule("r_name", {"WEST": ["AMERICA", "EUROPE"], "EAST": ["ASIA"]}, missing="OTHER", other="OTHER")
_STATUS_RULE = BinRule("status", {"CLOSED": ["F"]}, missing="NULL", other=KEEP)
_SEGMENT_CASE = """CASE WHEN segment IS NULL THEN 'UNKNOWN' WHEN segment IN ('AUTOMOBILE', 'MACHINERY') THEN 'BIN_A'
  WHEN segment = 'BUILDING' THEN 'BIN_B' ELSE 'NULL' END"""
_REGION_CASE = "CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 'WEST' WHEN r_name = 'ASIA' THEN 'EAST' ELSE 'OTHER' END"


@query(
    "bin_categories",
    f"""SELECT o_orderkey, {_SEGMENT_CASE} AS segment, {_REGION_CASE} AS r_name
    FROM (SELECT *, nullif(c_mktsegment, 'FURNITURE') AS segment FROM ({sql.ORDER_FEATURES}))""",
)
def bin_categories(spark, folder):
    """Bins with a bin for missing values and another for unlisted ones."""
    df = ft.order_features(spark, folder).select(
        "o_orderkey", F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("segment"), "r_name"
    )
    return binning.bin_fields(df, [_SEGMENT_RULE, _REGION_RULE])


@query(
    "bin_missing_named",
    """SELECT o_orderkey, CASE WHEN place IS NULL THEN 'WEST' WHEN place IN ('AMERICA', 'EUROPE') THEN 'WEST' WHEN place = 'ASIA' THEN 'EAST'
      ELSE 'ELSEWHERE' END AS place FROM (SELECT o_orderkey, nullif(r_name, 'AFRICA') AS place FROM (""" + sql.ORDER_FEATURES + "))",
)
def bin_missing_named(spark, folder):
    """Missing values go into a bin that listed values have too, unlisted ones into another."""
    df = ft.order_features(spark, folder).select("o_orderkey", F.nullif(F.col("r_name"), F.lit("AFRICA")).alias("place"))
    return binning.bin_fields(df, [BinRule("place", _REGION_RULE.bins, missing="WEST", other="ELSEWHERE")])


@query(
    "bin_default_keep",
    """SELECT o_orderkey, CASE WHEN status IS NULL THEN 'NULL' WHEN status = 'F' THEN 'CLOSED' ELSE status END AS status
    FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)""",
)
def bin_default_keep(spark, folder):
    """Unlisted values stay as they are."""
    df = ft.table(spark, folder, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")
    )
    return binning.bin_fields(df, [_STATUS_RULE])


@query(
    "bin_blank_missing",
    """SELECT o_orderkey, CASE WHEN code IS NULL OR code = '     ' THEN 'UNKNOWN' WHEN code = 'P' THEN 'PENDING'
      ELSE 'OTHER' END AS code
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '     ' ELSE nullif(o_orderstatus, 'O') END AS code FROM orders)""",
)
def bin_blank_missing(spark, folder):
    """A blank code counts as missing."""
    status = F.col("o_orderstatus")
    code = F.when(status == "F", "     ").otherwise(F.nullif(status, F.lit("O")))
    df = ft.table(spark, folder, "orders").select("o_orderkey", code.alias("code"))
    return binning.bin_fields(df, [BinRule("code", {"PENDING": ["P"]}, other="OTHER", blanks=("     ",))])


_PRICE_RULES = """SELECT 'p_brand' AS var, p_brand AS val,
  CASE WHEN avg(p_retailprice) >= 950 THEN 'HIGH' ELSE 'LOW' END AS bin FROM part GROUP BY p_brand HAVING count(*) > 1
  UNION ALL SELECT 'p_type', p_type, CASE WHEN max(p_size) >= 50 THEN 'BIG' ELSE 'SMALL' END FROM part GROUP BY p_type"""


def _price_rules(spark, folder):
    part = ft.table(spark, folder, "part")
    brand = (
        part.groupBy(F.col("p_brand").alias("val"))
        .agg(F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.lit("p_brand").alias("var"), "val", F.when(F.col("price") >= 950, "HIGH").otherwise("LOW").alias("bin"))
    )
    kind = part.groupBy(F.col("p_type").alias("val")).agg(F.max("p_size").alias("size"))
    return brand.union(
        kind.select(F.lit("p_type"), "val", F.when(F.col("size") >= 50, "BIG").otherwise("SMALL").alias("bin"))
    )


@query(
    "bin_by_rule_table",
    f"""WITH rules AS ({_PRICE_RULES})
    SELECT p.p_partkey, coalesce(b.bin, 'OTHER') AS p_brand, coalesce(t.bin, 'OTHER') AS p_type
    FROM part p LEFT JOIN rules b ON b.var = 'p_brand' AND b.val = p.p_brand
    LEFT JOIN rules t ON t.var = 'p_type' AND t.val = p.p_type""",
)
def bin_by_rule_table(spark, folder):
    """Bins from a rule table that is itself computed from the data; its size decides the way."""
    parts = ft.table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    settings = [BinRule("p_brand", missing="UNKNOWN", other="OTHER"), BinRule("p_type", missing="UNKNOWN", other="OTHER")]
    return binning.bin_by_table(parts, _price_rules(spark, folder), settings)


@query(
    "bin_rule_text",
    f"""WITH rules AS ({_PRICE_RULES}), listed AS (
      SELECT var, bin, string_agg('''' || val || '''', ', ' ORDER BY val) AS vals FROM rules GROUP BY var, bin)
    SELECT var, string_agg(var || ' IN (' || vals || ') -> ''' || bin || '''', ',' || chr(10) ORDER BY bin) AS rule
    FROM listed GROUP BY var""",
)
def bin_rule_text(spark, folder):
    return binning.rule_text(_price_rules(spark, folder))


@query(
    "bin_numeric",
    f"""SELECT o_orderkey, """
    + ", ".join(
        f"CASE WHEN {n} = -1 THEN 'NULL' WHEN {n} = 0 THEN 'ZERO' ELSE '1PLUS' END AS {n}" for n in ["ret_cnt", "open_cnt"]
    )
    + f""" FROM (SELECT o_orderkey, ret_cnt, coalesce(open_cnt, -1) AS open_cnt FROM ({sql.ORDER_FEATURES}))""",
)
def bin_numeric(spark, folder):
    """Only the sentinel is missing: ``ret_cnt`` keeps its NULLs, which count as 1PLUS."""
    df = ft.order_features(spark, folder).select("o_orderkey", "ret_cnt", F.coalesce("open_cnt", F.lit(-1)).alias("open_cnt"))
    return cleaning.count_bins(df, ["ret_cnt", "open_cnt"])


_INSTALLS = [f"INST_{i}" for i in range(1, 8)]


@query(
    "install_count_bin",
    f"""SELECT o_orderkey, CASE WHEN t > 0 AND t <= 5 THEN '1TO5' WHEN t >= 6 THEN '6PLUS' ELSE 'NULL' END AS installs
    FROM (SELECT o.o_orderkey, {" + ".join(f"l.{n}" for n in _INSTALLS)} AS t FROM orders o LEFT JOIN (
      SELECT l_orderkey, {", ".join(f"max(CASE WHEN l_linenumber = {i} THEN 1 ELSE 0 END) AS INST_{i}" for i in range(1, 8))}
      FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey)""",
)
def install_count_bin(spark, folder):
    """Flags summed across columns and binned; the flags go."""
    flags = [F.max(F.when(F.col("l_linenumber") == i, 1).otherwise(0)).alias(n) for i, n in enumerate(_INSTALLS, 1)]
    lines = ft.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*flags)
    orders = ft.table(spark, folder, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return cleaning.install_count(orders, s.starts_with("INST_"), "installs")


# --- targets, one-hot and reshaping ---


@query(
    "target_flags",
    "SELECT o_orderkey, " + ", ".join(_flag("o_orderpriority", c, f"TARGET_{c}") for c in CLASSES) + " FROM orders",
)
def target_flags(spark, folder):
    return encoding.target_flags(ft.table(spark, folder, "orders"), "o_orderkey", "o_orderpriority")


@query(
    "target_flags_merged",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS "TARGET_1_2", """
    + ", ".join(_flag("o_orderpriority", c, f"TARGET_{c}") for c in CLASSES[2:])
    + " FROM orders",
)
def target_flags_merged(spark, folder):
    """Two classes merged before the flags are made."""
    merged = cells.merged_class(F.col("o_orderpriority"), CLASSES[:2], "1_2")
    df = ft.table(spark, folder, "orders").select("o_orderkey", merged.alias("o_orderpriority"))
    return encoding.target_flags(df, "o_orderkey", "o_orderpriority")


def _one_hot_sql(field, levels, clean=True):
    name = lambda v: f"{field}_{v}".replace(" ", "_").upper() if clean else f"{field}_{v}"
    return ", ".join(_flag(field, v, name(v)) for v in levels)


@query(
    "onehot_wide",
    f"""SELECT o_orderkey, {_one_hot_sql("c_mktsegment", SEGMENTS)}, {_one_hot_sql("r_name", REGIONS)},
      {_one_hot_sql("n_name", [f"NATION_{i}" for i in range(25)])} FROM ({sql.ORDER_FEATURES})""",
)
def onehot_wide(spark, folder):
    df = ft.order_features(spark, folder).select("o_orderkey", "c_mktsegment", "r_name", "n_name")
    fields = ["c_mktsegment", "r_name", "n_name"]
    return encoding.one_hot(df, fields, encoding.levels_of(df, fields))


@query(
    "onehot_long",
    """SELECT p_partkey, upper(replace(var || '_' || val, ' ', '_')) AS var, 1 AS dummy FROM (
      SELECT p_partkey, 'p_brand' AS var, coalesce(nullif(p_brand, 'Brand#1'), 'NA') AS val FROM part
      UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
      UNION ALL SELECT p_partkey, 'p_name', p_name FROM part)""",
)
def onehot_long(spark, folder):
    """The long form behind one-hot columns; a missing value is the level NA."""
    df = ft.table(spark, folder, "part").select(
        "p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("p_brand"), "p_type", "p_name"
    )
    return encoding.encoded_long(df, "p_partkey", ["p_brand", "p_type", "p_name"])


@query(
    "unpivot_text",
    """SELECT o_orderkey, 'o_orderstatus' AS var, o_orderstatus AS val FROM orders
    UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders
    UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders""",
)
def unpivot_text(spark, folder):
    fields = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    return encoding.long_form(ft.table(spark, folder, "orders"), ["o_orderkey"], fields)


@query(
    "dummify_maxcat",
    f"""SELECT c_name, c_custkey, n_name, {_one_hot_sql("c_mktsegment", SEGMENTS, False)},
      {_one_hot_sql("r_name", REGIONS, False)}
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def dummify_maxcat(spark, folder):
    """Text columns with at most 10 levels become 0/1 columns; names and nations are too wide and stay."""
    df = ft.customer_places(spark, folder).select("c_name", "c_custkey", "n_name", "c_mktsegment", "r_name")
    return encoding.dummify(df, 10)


@query(
    "trend_pattern",
    f"""SELECT user_id, CASE WHEN s = repeat('NULL_', 5) THEN 'ALL_NULL' WHEN s = repeat('U_', 5) THEN 'ALL_UP'
      WHEN s = repeat('D_', 5) THEN 'ALL_DOWN' ELSE '1PLUS_DIFF_UT' END AS pattern,
      CASE WHEN p = 'UU' THEN 'ALL_UP' WHEN p = 'DD' THEN 'ALL_DOWN' WHEN p = 'NULLNULL' THEN 'ALL_NULL'
      ELSE '1PLUS_DIFF_UT' END AS buying
    FROM (SELECT user_id, {" || '_' || ".join(f'"{t}_TREND_CATG"' for t in ft.EVENT_TYPES)} || '_' AS s,
      "purchase_TREND_CATG" || "signup_TREND_CATG" AS p FROM ({sql.EVENT_TRENDS}))""",
)
def trend_pattern(spark, folder):
    """One word for a row of trend codes."""
    trends = ft.event_trends(spark, folder)
    codes = [s.col(n) for n in s.ends_with("_trend_catg").names(trends)]
    buying = [s.col(f"{t}_TREND_CATG") for t in ("purchase", "signup")]
    return trends.select(
        "user_id", cells.trend_pattern(codes).alias("pattern"), cells.trend_pattern(buying).alias("buying")
    )


@query(
    "trend_codes_joined",
    f"""SELECT user_id, {" || '_' || ".join(f'"{t}_TREND_CATG"' for t in ft.EVENT_TYPES)} AS joined,
      coalesce(nullif("click_TREND_CATG", 'NULL'), 'NA') || '/' || "error_TREND_CATG" AS pair FROM ({sql.EVENT_TRENDS})""",
)
def trend_codes_joined(spark, folder):
    """Columns united to one text; a missing part is the text NA."""
    trends = ft.event_trends(spark, folder)
    click = F.nullif(F.col("click_TREND_CATG"), F.lit("NULL"))
    return trends.select(
        "user_id",
        cells.paste(*[F.col(f"{t}_TREND_CATG") for t in ft.EVENT_TYPES]).alias("joined"),
        cells.paste(click, F.col("error_TREND_CATG"), sep="/").alias("pair"),
    )


# --- whole preparation flows ---

_MASTER_NUMBERS = ["o_totalprice", "c_acctbal", *ft.ORDER_NUMBERS[2:]]


def _master_number(name):
    return f"round(coalesce({name}, -1), 4) AS {name}" if name in MONEY + ["qty_sum", "qty_max"] else f"coalesce({name}, -1) AS {name}"


@query(
    "prepared_master",
    f"""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS "TARGET_1_2",
      {", ".join(_flag("o_orderpriority", c, f"TARGET_{c}") for c in CLASSES[2:])},
      {", ".join(_master_number(n) for n in _MASTER_NUMBERS)},
      CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 1 ELSE 0 END AS "C_MKTSEGMENT_BIN_A",
      CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS "C_MKTSEGMENT_BIN_B",
      CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY', 'BUILDING') THEN 1 ELSE 0 END AS "C_MKTSEGMENT_NULL",
      CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END AS "R_NAME_EAST",
      CASE WHEN r_name NOT IN ('AMERICA', 'EUROPE', 'ASIA') THEN 1 ELSE 0 END AS "R_NAME_OTHER",
      CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 1 ELSE 0 END AS "R_NAME_WEST",
      {_one_hot_sql("o_orderstatus", STATUSES)}
    FROM ({sql.ORDER_FEATURES})""",
)
def prepared_master(spark, folder):
    """Targets, bins, one-hot and fills in one flow. The assembled table is staged: finding the levels
    and making the columns both read it."""
    segment = BinRule("c_mktsegment", _SEGMENT_RULE.bins)
    master = flows.master_table(
        stage(ft.order_features(spark, folder), "assembled"), "o_orderkey", "o_orderpriority",
        [segment, _REGION_RULE], {"1_2": CLASSES[:2]}, ["n_name"],
    )
    return _rounded(master, 4)


@query(
    "refreshed_shares",
    f"""SELECT CAST(c.c_custkey AS VARCHAR) AS c_custkey, c.c_mktsegment,
      CASE WHEN c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 1 ELSE 0 END AS open_flg,
      round(c.c_acctbal, 4) AS c_acctbal, c.all_order_cnt, c.f_flg, c.p_flg, round(l.all_rev_sum, 4) AS all_rev_sum,
      CAST(l.lagged_cnt AS BIGINT) AS lagged_cnt,
      {", ".join(f"round(coalesce(c.{p} / nullif(l.all_rev_sum, 0), 0), 6) AS {p}" for p in ["p1_rev_sum", "p2_rev_sum", "p3_rev_sum"])}
    FROM ({sql.CUSTOMER_FEATURES}) c LEFT JOIN ({_LAGGED}) l ON c.c_custkey = l.c_custkey""",
)
def refreshed_shares(spark, folder):
    """Columns refreshed by key, listed keys flagged, columns ordered, amounts turned into shares."""
    pending = ft.table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    table = flows.refreshed_table(
        s.without(ft.customer_features(spark, folder), "c_nationkey"), "c_custkey", _lagged(spark, folder), pending,
        "open_flg", s.matches("^p[123]_rev") & ~s.ends_with("_FLG"), "all_rev_sum", ["c_mktsegment"],
    )
    return table.select(
        *[F.round(s.col(n), 4 if n in ("c_acctbal", "all_rev_sum") else 6).alias(n) if n in
          ("c_acctbal", "all_rev_sum", "p1_rev_sum", "p2_rev_sum", "p3_rev_sum") else s.col(n) for n in table.columns]
    )


def _coded(case, field, levels):
    return ", ".join(f"CASE WHEN {case} = '{v}' THEN 1 ELSE 0 END AS \"{field}_{v}\"" for v in levels)


_COUNT_CASE = "CASE WHEN {0} = -1 THEN 'NULL' WHEN {0} = 0 THEN 'ZERO' ELSE '1PLUS' END"


@query(
    "encoded_codes",
    f"""SELECT o_orderkey, n_name, line_cnt,
      {_coded(_SEGMENT_CASE.replace("segment", "c_mktsegment"), "c_mktsegment", ["BIN_A", "BIN_B", "NULL"])},
      {_coded(_REGION_CASE, "r_name", ["EAST", "OTHER", "WEST"])},
      {_coded(_COUNT_CASE.format("ret_cnt"), "ret_cnt", ["1PLUS", "ZERO"])},
      {_coded(_COUNT_CASE.format("open_cnt"), "open_cnt", ["1PLUS", "NULL", "ZERO"])}
    FROM (SELECT o_orderkey, c_mktsegment, r_name, n_name, ret_cnt, coalesce(line_cnt, -1) AS line_cnt,
            coalesce(open_cnt, -1) AS open_cnt FROM ({sql.ORDER_FEATURES}))""",
)
def encoded_codes(spark, folder):
    """Codes and counts binned, filled, cleaned and one-hot encoded; the nations are too many and stay."""
    df = ft.order_features(spark, folder).select(
        "o_orderkey", "c_mktsegment", "r_name", "n_name", "line_cnt", "ret_cnt",
        F.coalesce("open_cnt", F.lit(-1)).alias("open_cnt"),
    )
    rules = [BinRule("c_mktsegment", _SEGMENT_RULE.bins), _REGION_RULE]
    return flows.encoded_codes(stage(df, "assembled"), rules, ["ret_cnt", "open_cnt"])


_CODE_FLAGS = ", ".join(
    f'CAST("{t}_TREND_CATG" = \'{v}\' AS INTEGER) AS "{t}_TREND_CATG_{v}"' for t in ft.EVENT_TYPES for v in cells.TREND_CODES
)
_ALL_CODES = " || ".join(f'"{t}_TREND_CATG" || \'_\'' for t in ft.EVENT_TYPES)
_WORD_FLAGS = ", ".join(f"CAST(word = '{w}' AS INTEGER) AS \"TREND_PATTERN_{w}\"" for w in cells.TREND_WORDS)


@query(
    "trend_features",
    f"""SELECT user_id, {_CODE_FLAGS}, {_WORD_FLAGS} FROM (
      SELECT *, CASE {_ALL_CODES} WHEN repeat('NULL_', 5) THEN 'ALL_NULL' WHEN repeat('U_', 5) THEN 'ALL_UP'
        WHEN repeat('D_', 5) THEN 'ALL_DOWN' ELSE '1PLUS_DIFF_UT' END AS word FROM ({sql.EVENT_TRENDS}))""",
)
def trend_features(spark, folder):
    """Trend codes and their pattern word as 0/1 columns."""
    trends = stage(ft.event_trends(spark, folder), "trends")
    return flows.trend_features(trends, "user_id", {"TREND_PATTERN": s.ends_with("_TREND_CATG")})


# --- files ---

_CUSTOMER_TYPES = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"


def _customers(spark, folder):
    df = ft.table(spark, folder, "customer")
    return df.withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))


@query("csv_roundtrip", _CUSTOMER_SQL)
def csv_roundtrip(spark, folder):
    """Written to the shared folder as CSV and read back with a schema; missing text survives."""
    path = shared_path(spark, "customers-csv")
    files.write_csv(_customers(spark, folder), path)
    return files.read_csv(spark, path, _CUSTOMER_TYPES)


@query("tab_roundtrip", _CUSTOMER_SQL)
def tab_roundtrip(spark, folder):
    path = shared_path(spark, "customers-tab")
    files.write_csv(_customers(spark, folder), path, sep="\t")
    return files.read_tab(spark, path, _CUSTOMER_TYPES)


@query(
    "stage_roundtrip",
    "SELECT l_orderkey, count(*) AS line_cnt, round(sum(l_extendedprice), 4) AS price_sum FROM lineitem GROUP BY l_orderkey",
)
def stage_roundtrip(spark, folder):
    """A stage table written to the shared folder and read back, columns pruned."""
    totals = stage(ft.line_totals(spark, folder), "lines")
    return totals.select(F.col("o_orderkey").alias("l_orderkey"), "line_cnt", F.round("price_sum", 4).alias("price_sum"))


# --- dictionaries, profiles, text with line breaks ---

_CODED = ["c_name", "c_mktsegment"]
_LEVELS_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS var, val, row_number() OVER (ORDER BY val) - 1 AS level FROM (SELECT DISTINCT {f} AS val FROM customer WHERE {f} IS NOT NULL)"
    for f in _CODED
)


@query("level_dictionary", _LEVELS_SQL)
def level_dictionary(spark, folder):
    """The levels of two fields as a numbered table, one of them as wide as the table itself."""
    return dictionary.levels(ft.table(spark, folder, "customer"), _CODED, part_rows=400)


@query(
    "sparse_codes",
    f"""WITH levels AS ({_LEVELS_SQL}), sizes AS (SELECT var, count(*) AS n FROM levels GROUP BY var),
    placed AS (SELECT l.var, val, level + CASE WHEN l.var = '{_CODED[0]}' THEN 0 ELSE (SELECT n FROM sizes WHERE var = '{_CODED[0]}') END AS c FROM levels l)
    SELECT c_custkey, (SELECT CAST(sum(n) AS BIGINT) FROM sizes) AS width, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS columns
    FROM customer LEFT JOIN placed ON (var = 'c_name' AND val = c_name) OR (var = 'c_mktsegment' AND val = c_mktsegment) GROUP BY c_custkey""",
)
def sparse_codes(spark, folder):
    """One-hot rows of more levels than a plan has columns, as lists of column numbers."""
    codes = dictionary.sparse_codes(ft.table(spark, folder, "customer"), "c_custkey", _CODED)
    return codes.select("c_custkey", "width", F.array_join(F.transform("columns", lambda c: c.cast("string")), ",").alias("columns"))


_PROFILED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]


@query(
    "merged_profile",
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) AS rows, count(*) FILTER ({f} IS NULL) AS missing, "
        + (f"min(CAST({f} AS DOUBLE)) AS least, max(CAST({f} AS DOUBLE)) AS most, " if f != "l_returnflag" else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), ")
        + "true AS close FROM lineitem"
        for f in _PROFILED
    ),
)
def merged_profile(spark, folder):
    """Profiles stored per group of rows, merged without reading the rows again; the distinct counts are within 4 %."""
    lines = ft.table(spark, folder, "lineitem")
    stored = stage(profiles.profile(lines, _PROFILED, by="l_linestatus"), "profiles")
    exact = ranking.cardinality(lines, _PROFILED)
    found = profiles.estimates(profiles.merged(stored)).join(exact, "field")
    close = (F.abs(F.col("distinct_estimate") - F.col("levels")) <= 0.04 * F.col("levels")).alias("close")
    return found.select("field", "rows", "missing", "least", "most", close)


@query(
    "csv_line_breaks",
    """SELECT n_nationkey AS key, replace(n_name, 'A', 'A' || chr(10)) AS name, n_name AS "name.1", n_regionkey AS "key.1" FROM nation""",
)
def csv_line_breaks(spark, folder):
    """Quoted line breaks and repeated headers survive a round trip."""
    nation = ft.table(spark, folder, "nation")
    broken = F.replace(F.col("n_name"), F.lit("A"), F.lit("A\n"))
    path = shared_path(spark, "broken")
    files.write_csv(nation.select(F.col("n_nationkey").alias("key"), broken.alias("name"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("key")), path)
    return files.read_csv(spark, path, line_breaks=True)
