"""Registered queries: aggregates, ranking, splits, shadows, importance and forest selection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from broadloom.functions import cells
from broadloom.operators import correlation, encoding, forests, importance as imp, joins, ranking, shadows, splitting
from broadloom.plans import features as ft, flows, presets, twin_sql as sql
from broadloom.plans.correlation_queries import CLASSES, FLAGGED_SQL, NUMBERS, TARGETS
from broadloom.plans.registry import query
from broadloom.session import stage

SEED = presets.SEED


def _hash(key, seed=SEED):
    return f"md5('{seed}|' || CAST({key} AS VARCHAR))"


def _hash_int(key, seed=SEED):
    return f"CAST('0x' || substr({_hash(key, seed)}, 1, 8) AS BIGINT)"


# --- aggregates and windows ---


@query(
    "class_counts_share",
    """SELECT c_mktsegment, o_orderpriority, n, CAST(sum(n) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS total,
      round(n / sum(n) OVER (PARTITION BY c_mktsegment), 6) AS share
    FROM (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
          GROUP BY c_mktsegment, o_orderpriority)""",
)
def class_counts_share(spark, folder):
    """Two-level count with the group total beside each row. Orders are counted per customer before
    the join, so a customer with very many orders is a few rows there."""
    per_customer = (
        ft.table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = (
        per_customer.join(ft.table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("c_mktsegment"))
    return counts.select("*", total.alias("total"), F.round(F.col("n") / total, 6).alias("share"))


_GUESSED = f"""SELECT o_orderpriority, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN o_totalprice > 400000 THEN '1-URGENT'
  WHEN o_totalprice > 250000 THEN '2-HIGH' ELSE '5-LOW' END AS guess FROM ({sql.ORDER_FEATURES})"""


@query(
    "baseline_accuracy",
    f"""SELECT o_orderpriority, total, hits, misses, unknown, round(hits / total, 6) AS prct,
      round(hits / (hits + misses), 6) AS prct_pos
    FROM (SELECT o_orderpriority, count(*) AS total, nullif(count(*) FILTER (WHERE guess = o_orderpriority), 0) AS hits,
      nullif(count(*) FILTER (WHERE guess <> o_orderpriority), 0) AS misses,
      nullif(count(*) FILTER (WHERE guess IS NULL), 0) AS unknown FROM ({_GUESSED}) GROUP BY o_orderpriority)""",
)
def baseline_accuracy(spark, folder):
    """How often a last-touch rule is right, per class, best first."""
    price = F.col("o_totalprice")
    guess = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
        .when(price > 400000, "1-URGENT")
        .when(price > 250000, "2-HIGH")
        .otherwise("5-LOW")
    )
    df = ft.order_features(spark, folder).select("o_orderpriority", guess.alias("guess"))
    table = ranking.rule_accuracy(df, "o_orderpriority", "guess")
    rounded = table.withColumns({n: F.round(n, 6) for n in ("prct", "prct_pos")})
    return ranking.ordered(rounded, down=["prct"])


@query(
    "listed_values",
    """SELECT p_brand, string_agg(p_type, ', ' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part)
    GROUP BY p_brand""",
)
def listed_values(spark, folder):
    """Distinct values per group as one text. They are made distinct first, so each list is short."""
    pairs = ft.table(spark, folder, "part").select("p_brand", "p_type").distinct()
    return pairs.groupBy("p_brand").agg(F.expr("listagg(p_type, ', ') WITHIN GROUP (ORDER BY p_type)").alias("types"))


@query(
    "first_per_key",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def first_per_key(spark, folder):
    """The first row per key, whole, by an explicit order."""
    orders = ft.table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return ranking.first_per(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "top_per_group",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    WHERE rn <= 150""",
)
def top_per_group(spark, folder):
    orders = ft.table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ranking.top_per(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 150)


@query("top_overall", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 150")
def top_overall(spark, folder):
    orders = ft.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return ranking.largest(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 150)


@query(
    "stacked_lists",
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL AS kind FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier' FROM supplier
    UNION ALL SELECT p_partkey, p_name, NULL, p_type FROM part""",
)
def stacked_lists(spark, folder):
    """Union by name; a column a table lacks is missing there."""
    customer = ft.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    supplier = ft.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"),
        F.col("s_acctbal").alias("balance"),
    )
    part = ft.table(spark, folder, "part").select(
        F.col("p_type").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name")
    )
    return ranking.stacked([customer, supplier, part])


_PROFILED = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
]


@query(
    "cardinality_profile",
    " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT {f}) AS levels FROM lineitem" for f in _PROFILED),
)
def cardinality_profile(spark, folder):
    return ranking.cardinality(ft.table(spark, folder, "lineitem"), _PROFILED)


_RULES = (("starts", "P_BRAND_BRAND#1", "BRAND 1X"), ("contains", "BRAND", "BRAND"), ("contains", "NAME_", "NAME"))


@query(
    "field_taxonomy_chunks",
    """WITH f AS (SELECT DISTINCT upper(replace(field, ' ', '_')) AS field FROM (
      SELECT 'p_brand_' || p_brand AS field FROM part UNION ALL SELECT 'p_name_' || p_name FROM part
      UNION ALL SELECT 'p_type_' || p_type FROM part)),
    typed AS (SELECT field, CASE WHEN starts_with(field, 'P_BRAND_BRAND#1') THEN 'BRAND 1X' WHEN contains(field, 'BRAND') THEN 'BRAND'
      WHEN contains(field, 'NAME_') THEN 'NAME' ELSE 'OTHER' END AS type FROM f)
    SELECT field, type, CAST((row_number() OVER (ORDER BY type, field) - 1) // 15 AS INTEGER) AS chunk FROM typed""",
)
def field_taxonomy_chunks(spark, folder):
    """The fields one-hot encoding of ``part`` gives, typed by name and cut into chunks of 15."""
    levels = encoding.level_table(ft.table(spark, folder, "part"), ["p_brand", "p_name", "p_type"])
    fields = levels.select(cells.clean_name(cells.paste(F.col("var"), F.col("val"))).alias("field")).distinct()
    return ranking.numbered_chunks(ranking.taxonomy(fields, _RULES), ["type", "field"], 15)


# --- splits ---


@query(
    "split_80_20",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_hash("o_orderkey")})
      <= round({presets.TRAIN_SHARE} * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def split_80_20(spark, folder):
    """Exactly 80 % of the rows, chosen by key hash, without a global sort."""
    return splitting.exact_split(ft.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", presets.TRAIN_SHARE, SEED)


@query(
    "split_threshold",
    f"""SELECT o_orderkey, CASE WHEN {_hash_int("o_orderkey")} < {int(presets.TRAIN_SHARE * 2**32)} THEN 'train' ELSE 'test' END AS part
    FROM orders""",
)
def split_threshold(spark, folder):
    return splitting.threshold_split(ft.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", presets.TRAIN_SHARE, SEED)


@query(
    "split_complement",
    f"""SELECT o_orderkey, o_totalprice FROM orders WHERE {_hash_int("o_orderkey")} >= {int(presets.TRAIN_SHARE * 2**32)}""",
)
def split_complement(spark, folder):
    """The test rows as the rows left over by the train rows."""
    orders = ft.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    train = splitting.threshold_split(orders, "o_orderkey", presets.TRAIN_SHARE, SEED).where("part = 'train'")
    return joins.complement(orders, train, "o_orderkey")


@query(
    "fold_numbers",
    " UNION ALL ".join(
        f"SELECT {r} AS repeat, o_orderkey, CAST({_hash_int('o_orderkey', f'{SEED}.{r}')} % 5 AS INTEGER) AS fold FROM orders"
        for r in range(5)
    ),
)
def fold_numbers(spark, folder):
    """Folds of a five times repeated five-fold cross-validation."""
    orders = ft.table(spark, folder, "orders").select("o_orderkey")
    return ranking.stacked(
        orders.select(F.lit(r).alias("repeat"), "o_orderkey", splitting.fold(F.col("o_orderkey"), 5, SEED, r).alias("fold"))
        for r in range(5)
    )


# --- shadows and importance that SQL can follow ---

RUNS = range(1, 11)
FIELDS = ["o_totalprice", "c_acctbal", "line_cnt", "qty_sum", "disc_sum", "tax_sum", "ret_cnt", "open_cnt", "qty_max"]
RESPONSE = "price_sum"
_PER_BLOCK = 1000


def _blocks(spark, folder):
    """All orders in shadow blocks: features, and the order's totals as responses; missing totals are -1."""
    columns = [*FIELDS, RESPONSE, "net_sum"]
    missing = F.lit(float(cells.MISSING_NUMBER))
    df = ft.order_features(spark, folder)
    kept = df.select(ft.ORDER_KEY, *[F.coalesce(F.col(n).cast("double"), missing).alias(n) for n in columns])
    staged = stage(kept, "features")
    count = shadows.block_count(staged.count(), _PER_BLOCK)
    return shadows.shadow_blocks(staged, ft.ORDER_KEY, [ft.ORDER_KEY, *columns], count, SEED)


def _history(spark, folder, responses=(RESPONSE,)):
    """Importance as |r| with each response, for the fields and for the shadows of every run."""
    rows = shadows.with_shadows(_blocks(spark, folder), [*FIELDS, *responses], FIELDS, RUNS, SEED)
    names = {shadows.shadow_name(f, r): (r, f) for r in RUNS for f in FIELDS}
    pairs = correlation.correlation_pairs(rows, [*FIELDS, *names], responses, strategy="gram")
    # real fields have no run of their own: they stand in every run
    known = [(n, [r], f, True) for n, (r, f) in names.items()] + [(f, list(RUNS), f, False) for f in FIELDS]
    labels = spark.createDataFrame(known, "x string, runs array<int>, field string, is_shadow boolean")
    score = F.coalesce(F.abs("r"), F.lit(0.0)).alias("importance")
    return pairs.join(labels, "x").select(
        F.col("y").alias("target"), F.explode("runs").alias("run"), "field", score, "is_shadow"
    )


def _offset_sql(run, field, size):
    draw = f"CAST('0x' || substr(md5('{SEED}|' || {run} || '|' || {field}), 1, 8) AS BIGINT)"
    return f"({draw} % greatest({size} - 1, 1) + 1)"


def _blocks_sql(source, columns, fields, runs):
    """``placed`` rows in blocks, ``vals`` of the fields and their shadows ``moved`` for every run; no missing values."""
    filled = ", ".join(f"coalesce(CAST({n} AS DOUBLE), {cells.MISSING_NUMBER}) AS {n}" for n in columns)
    return f"""base AS (SELECT {ft.ORDER_KEY}, {filled} FROM ({source})),
sized AS (
  SELECT *, CAST({_hash_int(ft.ORDER_KEY)} % ceil((SELECT count(*) FROM base) / {_PER_BLOCK}.0) AS INTEGER) AS block,
         {_hash(ft.ORDER_KEY, f"{SEED}.order")} AS h FROM base),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY block ORDER BY h) - 1 AS pos, count(*) OVER (PARTITION BY block) AS size
  FROM sized),
vals AS ({" UNION ALL ".join(f"SELECT block, pos, size, '{f}' AS field, {f} AS v FROM placed" for f in fields)}),
runs AS (SELECT range AS run FROM range({runs[0]}, {runs[-1] + 1})),
moved AS (
  SELECT r.run, v.field, v.block, (v.pos + v.size - {_offset_sql("r.run", "v.field", "v.size")}) % v.size AS pos, v.v
  FROM vals v CROSS JOIN runs r)"""


_SHADOW_SQL = f"""{_blocks_sql(sql.ORDER_FEATURES, [*FIELDS, RESPONSE, "net_sum"], FIELDS, RUNS)},
history AS (
  SELECT m.run, m.field, coalesce(abs(covar_pop(m.v, p.{RESPONSE})
           / nullif(stddev_pop(m.v) * stddev_pop(p.{RESPONSE}), 0)), 0) AS importance, true AS is_shadow
  FROM moved m JOIN placed p ON m.block = p.block AND m.pos = p.pos GROUP BY m.run, m.field
  UNION ALL
  SELECT r.run, v.field, coalesce(abs(covar_pop(v.v, p.{RESPONSE})
           / nullif(stddev_pop(v.v) * stddev_pop(p.{RESPONSE}), 0)), 0), false
  FROM vals v JOIN placed p ON v.block = p.block AND v.pos = p.pos CROSS JOIN runs r GROUP BY r.run, v.field),
best AS (SELECT run, max(importance) AS shadow_max FROM history WHERE is_shadow GROUP BY run),
hits AS (
  SELECT h.run, h.field, h.importance, b.shadow_max, CASE WHEN h.importance > b.shadow_max THEN 1 ELSE 0 END AS hit
  FROM history h JOIN best b ON h.run = b.run WHERE NOT h.is_shadow)"""


@query(
    "shadow_columns",
    f"""WITH {_SHADOW_SQL}
    SELECT p.o_orderkey, round(p.qty_sum, 4) AS qty_sum, round(q.v, 4) AS shadow_qty_sum, round(d.v, 4) AS shadow_disc_sum
    FROM placed p JOIN moved q ON p.block = q.block AND p.pos = q.pos AND q.run = 1 AND q.field = 'qty_sum'
    JOIN moved d ON p.block = d.block AND p.pos = d.pos AND d.run = 1 AND d.field = 'disc_sum'""",
)
def shadow_columns(spark, folder):
    """Shuffled copies of columns, each row shown with the values it received."""
    rows = shadows.with_shadows(_blocks(spark, folder), [ft.ORDER_KEY, *FIELDS], ["qty_sum", "disc_sum"], [1], SEED)
    shown = {n: shadows.shadow_name(n, 1) for n in ("qty_sum", "disc_sum")}
    return rows.select(
        ft.ORDER_KEY,
        F.round("qty_sum", 4).alias("qty_sum"),
        *[F.round(c, 4).alias(f"shadow_{n}") for n, c in shown.items()],
    )


@query(
    "shadow_hits",
    f"""WITH {_SHADOW_SQL} SELECT CAST(run AS INTEGER) AS run, field, round(importance, 6) AS importance,
      round(shadow_max, 6) AS shadow_max, hit FROM hits""",
)
def shadow_hits(spark, folder):
    """Fields against the best shadow of each run."""
    rounded = [F.round(n, 6).alias(n) for n in ("importance", "shadow_max")]
    return imp.hits(_history(spark, folder)).select("run", "field", *rounded, "hit")


@query(
    "importance_stats",
    f"""WITH {_SHADOW_SQL}, chances AS (
      SELECT h, (SELECT sum(exp(lgamma({len(RUNS) + 1}) - lgamma(k + 1) - lgamma({len(RUNS) + 1} - k))) FROM range(h, {len(RUNS) + 1}) t(k)) / pow(2, {len(RUNS)}) AS up,
             (SELECT sum(exp(lgamma({len(RUNS) + 1}) - lgamma(k + 1) - lgamma({len(RUNS) + 1} - k))) FROM range(0, h + 1) t(k)) / pow(2, {len(RUNS)}) AS down
      FROM range(0, {len(RUNS) + 1}) s(h)),
    stats AS (
      SELECT field, avg(importance) AS mean_imp, median(importance) AS median_imp, min(importance) AS min_imp,
             max(importance) AS max_imp, sum(hit) AS hit_count FROM hits GROUP BY field)
    SELECT field, {sql.rounded(["mean_imp", "median_imp", "min_imp", "max_imp"])},
      round(hit_count / {len(RUNS)}, 6) AS norm_hits,
      CASE WHEN c.up * {len(FIELDS)} < 0.01 THEN 'Confirmed' WHEN c.down * {len(FIELDS)} < 0.01 THEN 'Rejected'
           ELSE 'Tentative' END AS decision
    FROM stats s JOIN chances c ON c.h = s.hit_count""",
)
def importance_stats(spark, folder):
    """Statistics, hit share and binomial decision per field."""
    runs = len(RUNS)
    table = imp.statistics(imp.hits(_history(spark, folder)), runs)
    hit_count = F.round(F.col("norm_hits") * runs)
    rounded = [F.round(n, 6).alias(n) for n in table.columns if n != "field"]
    return table.select("field", *rounded, imp.decision(hit_count, runs, len(FIELDS)).alias("decision"))


_CHUNK = 5
_RESPONSES = ["price_sum", "net_sum"]


def _chunk_history_sql():
    r = "abs(covar_pop({v}, p.{t}) / nullif(stddev_pop({v}) * stddev_pop(p.{t}), 0))"
    parts = []
    for t in _RESPONSES:
        moved, real = f"coalesce({r.format(v='m.v', t=t)}, 0)", f"coalesce({r.format(v='v.v', t=t)}, 0)"
        parts.append(
            f"SELECT '{t}' AS target, m.run, m.field, {moved} AS importance, true AS is_shadow "
            "FROM moved m JOIN placed p ON m.block = p.block AND m.pos = p.pos GROUP BY m.run, m.field "
            f"UNION ALL SELECT '{t}', r.run, v.field, {real}, false "
            "FROM vals v JOIN placed p ON v.block = p.block AND v.pos = p.pos CROSS JOIN runs r GROUP BY r.run, v.field"
        )
    return " UNION ALL ".join(parts)


@query(
    "chunked_ranking",
    f"""WITH {_SHADOW_SQL[: _SHADOW_SQL.index("history AS (")]}
    fields(ordinal, field) AS (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(FIELDS))}),
    history AS (SELECT h.*, f.ordinal // {_CHUNK} AS chunk FROM ({_chunk_history_sql()}) h JOIN fields f ON h.field = f.field),
    best AS (SELECT target, chunk, run, max(importance) AS shadow_max FROM history WHERE is_shadow GROUP BY target, chunk, run),
    stats AS (
      SELECT h.target, h.chunk, h.field, median(h.importance) AS median_imp,
        sum(CASE WHEN h.importance > b.shadow_max THEN 1 ELSE 0 END) / {len(RUNS)} AS norm_hits
      FROM history h JOIN best b ON h.target = b.target AND h.chunk = b.chunk AND h.run = b.run
      WHERE NOT h.is_shadow GROUP BY h.target, h.chunk, h.field),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY median_imp DESC NULLS LAST, field) AS rank,
      CASE target {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(_RESPONSES, 1))} END AS list_no FROM stats)
    SELECT field, target, CAST(chunk AS INTEGER) AS chunk, list_no, CAST(rank AS INTEGER) AS rank,
      round(median_imp, 6) AS median_imp, round(norm_hits, 6) AS norm_hits
    FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY list_no, rank) AS rn FROM ranked WHERE rank <= 4)
    WHERE rn = 1""",
)
def chunked_ranking(spark, folder):
    """Column chunks with their own shadows, two targets, statistics per chunk, and the best four fields
    of each target combined: chunked selection with an importance that SQL can follow."""
    history = _history(spark, folder, _RESPONSES)
    fields = spark.createDataFrame(list(enumerate(FIELDS)), "ordinal int, field string")
    chunks = ranking.numbered_chunks(fields, ["ordinal"], _CHUNK).select("field", "chunk")
    within = ["target", "chunk"]
    stats = imp.statistics(imp.hits(history.join(chunks, "field"), within), len(RUNS), within)
    best = imp.first_listed(stats, _RESPONSES, 4)
    rounded = [F.round(n, 6).alias(n) for n in ("median_imp", "norm_hits")]
    return best.select("field", "target", "chunk", F.col("list_no").cast("int").alias("list_no"), "rank", *rounded)


_LISTED = TARGETS[:3]


@query(
    "combine_topk_first",
    f"""WITH {sql.target_pairs(FLAGGED_SQL, NUMBERS, _LISTED)},
    best AS (SELECT x AS field, y AS target, y_ord + 1 AS list_no, round(abs(r), 9) AS median_imp,
      row_number() OVER (PARTITION BY y ORDER BY round(abs(r), 9) DESC NULLS LAST, x) AS rank FROM pairs)
    SELECT field, target, CAST(list_no AS INTEGER) AS list_no, CAST(rank AS INTEGER) AS rank, round(median_imp, 6) AS median_imp FROM (
      SELECT *, row_number() OVER (PARTITION BY field ORDER BY list_no, rank) AS rn FROM best WHERE rank <= 5) WHERE rn = 1""",
)
def combine_topk_first(spark, folder):
    """The best five fields of three targets; a field listed twice keeps its first place."""
    df = ft.order_features(spark, folder)
    flags = encoding.flag_columns("o_orderpriority", CLASSES)
    flagged = df.select("*", *[flags[t].alias(t) for t in _LISTED])
    pairs = correlation.correlation_pairs(flagged, NUMBERS, _LISTED)
    ranked = pairs.select(F.col("y").alias("target"), F.col("x").alias("field"), F.round(F.abs("r"), 9).alias("median_imp"))
    best = imp.first_listed(ranked, _LISTED, 5)
    return best.select("field", "target", F.col("list_no").cast("int").alias("list_no"), "rank", F.round("median_imp", 6).alias("median_imp"))


# --- forests of one split, which SQL can follow ---

STUMP_FIELDS = ["line_cnt", "ret_cnt", "open_cnt", "priority", "band", "status"]
_STUMP_SQL = f"""SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(floor(o_totalprice / 50000) AS INTEGER) AS band,
  CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS status, CASE WHEN qty_sum > 100 THEN 1 ELSE 0 END AS busy
  FROM ({sql.ORDER_FEATURES})"""
_STUMP = forests.Forest(trees=1, depth=1, importance="permutation", seed=SEED)
_STUMP_RUNS = 11


def _stump_table(spark, folder):
    """All orders with small whole numbers as fields and a 0/1 target."""
    df = ft.order_features(spark, folder)
    status = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return df.select(
        "*", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.floor(F.col("o_totalprice") / 50000).cast("int").alias("band"), status.alias("status"),
        F.when(F.col("qty_sum") > 100, 1).otherwise(0).alias("busy"),
    )


def _best_split_sql(train, group):
    """``splits`` and ``best``: the split of each group with the largest gain, ``g = (field, shadow, cut, low, high)``."""
    keys = f"{group}, field, is_shadow"
    return f"""tally AS (SELECT {keys}, v, count(*) AS n, sum(label) AS s FROM {train} GROUP BY {keys}, v),
splits AS (
  SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER t AS nt, sum(s) OVER t AS st, lead(v) OVER w AS nv FROM tally
  WINDOW w AS (PARTITION BY {keys} ORDER BY v), t AS (PARTITION BY {keys})),
best AS (
  SELECT {group}, arg_max({{'field': field, 'shadow': is_shadow, 'cut': (v + nv) / 2, 'low': sl / nl, 'high': (st - sl) / (nt - nl)}},
    sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)) AS g FROM splits WHERE nv IS NOT NULL GROUP BY {group})"""


@query(
    "boruta_stumps",
    f"""WITH {_blocks_sql(_STUMP_SQL, [*STUMP_FIELDS, "busy"], STUMP_FIELDS, range(1, _STUMP_RUNS))},
    inputs AS (SELECT run, block, pos, field, v, false AS is_shadow FROM vals CROSS JOIN runs
      UNION ALL SELECT run, block, pos, field, v, true FROM moved),
    train AS (SELECT i.run, i.field, i.is_shadow, i.v, p.busy AS label FROM inputs i JOIN placed p ON p.block = i.block AND p.pos = i.pos
      WHERE (i.pos + i.run) % 3 <> 0),
    {_best_split_sql("train", "run")},
    held AS (
      SELECT i.run, i.block, i.v, p.busy AS label, b.g,
        row_number() OVER (PARTITION BY i.run, i.block ORDER BY i.pos) - 1 AS spot, count(*) OVER (PARTITION BY i.run, i.block) AS m
      FROM inputs i JOIN best b ON b.run = i.run AND b.g.field = i.field AND b.g.shadow = i.is_shadow
      JOIN placed p ON p.block = i.block AND p.pos = i.pos WHERE (i.pos + i.run) % 3 = 0),
    turned AS (
      SELECT run, block, spot, label, g, v,
        (spot + {_offset_sql("(run || '.held')", "CASE WHEN g.shadow THEN 'shadow_' || run || '_' || g.field ELSE g.field END", "m")}) % m AS other
      FROM held),
    losses AS (
      SELECT a.run, a.g, CASE WHEN b.v <= a.g.cut THEN a.g.low ELSE a.g.high END AS moved_guess,
        CASE WHEN a.v <= a.g.cut THEN a.g.low ELSE a.g.high END AS guess, a.label
      FROM turned a JOIN held b ON b.run = a.run AND b.block = a.block AND b.spot = a.other),
    won AS (SELECT run, any_value(g.field) AS field, any_value(g.shadow) AS is_shadow,
      avg((moved_guess - label) * (moved_guess - label) - (guess - label) * (guess - label)) AS importance FROM losses GROUP BY run),
    names(field) AS (VALUES {", ".join(f"('{f}')" for f in STUMP_FIELDS)}),
    hits AS (
      SELECT n.field, CASE WHEN NOT w.is_shadow AND w.field = n.field THEN w.importance ELSE 0 END AS importance,
        CASE WHEN NOT w.is_shadow AND w.field = n.field AND w.importance > 0 THEN 1 ELSE 0 END AS hit FROM names n CROSS JOIN won w)
    SELECT field, CASE sum(hit) WHEN 10 THEN 'Confirmed' WHEN 0 THEN 'Rejected' ELSE 'Tentative' END AS decision,
      round(avg(importance), 6) AS mean_imp, round(median(importance), 6) AS median_imp, round(min(importance), 6) AS min_imp,
      round(max(importance), 6) AS max_imp, round(sum(hit) / 10, 6) AS norm_hits
    FROM hits GROUP BY field""",
)
def boruta_stumps(spark, folder):
    """All-relevant selection with permutation importance, by forests of one tree with one split."""
    found = forests.all_relevant(_stump_table(spark, folder), ft.ORDER_KEY, "busy", STUMP_FIELDS, _STUMP_RUNS, _STUMP).fields
    rounded = [F.round(n, 6).alias(n) for n in ("mean_imp", "median_imp", "min_imp", "max_imp", "norm_hits")]
    return found.select("field", "decision", *rounded)


_STUMP_REPEATS = 2


@query(
    "rfe_stumps",
    f"""WITH base AS (SELECT {ft.ORDER_KEY}, busy, {", ".join(f"coalesce(CAST({f} AS DOUBLE), {cells.MISSING_NUMBER}) AS {f}" for f in STUMP_FIELDS)} FROM ({_STUMP_SQL})),
    folds AS ({" UNION ALL ".join(f"SELECT {ft.ORDER_KEY}, {r} AS repeat, {_hash_int(ft.ORDER_KEY, f'{SEED}.{r}')} % 5 AS fold FROM base" for r in range(_STUMP_REPEATS))}),
    vals AS ({" UNION ALL ".join(f"SELECT {ft.ORDER_KEY}, '{f}' AS field, {f} AS v, busy AS label FROM base" for f in STUMP_FIELDS)}),
    held(held) AS (SELECT range FROM range(5)),
    train AS (SELECT repeat, held, field, false AS is_shadow, v, label FROM vals JOIN folds USING ({ft.ORDER_KEY}) JOIN held ON held <> fold),
    {_best_split_sql("train", "repeat, held")},
    seen AS (
      SELECT f.repeat, f.fold, v.label, CASE WHEN v.v <= b.g.cut THEN b.g.low ELSE b.g.high END AS guess
      FROM folds f JOIN best b ON b.repeat = f.repeat AND b.held = f.fold JOIN vals v ON v.{ft.ORDER_KEY} = f.{ft.ORDER_KEY} AND v.field = b.g.field),
    scores AS (
      SELECT sqrt(avg((guess - label) * (guess - label))) AS "RMSE", avg(abs(guess - label)) AS "MAE", pow(corr(guess, label), 2) AS "Rsquared"
      FROM seen GROUP BY repeat, fold),
    long AS (UNPIVOT scores ON "RMSE", "MAE", "Rsquared" INTO NAME metric VALUE value)
    SELECT CAST(size AS INTEGER) AS size, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd
    FROM long CROSS JOIN (VALUES (1), ({len(STUMP_FIELDS)})) s(size) GROUP BY size, metric""",
)
def rfe_stumps(spark, folder):
    """Recursive elimination by forests of one split: scores per subset size."""
    found = forests.recursive_elimination(
        _stump_table(spark, folder), ft.ORDER_KEY, "busy", STUMP_FIELDS, [1], presets.RESAMPLE_FOLDS, _STUMP_REPEATS, _STUMP
    )
    return found.profile.select("size", "metric", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_CLASS_STUMP = forests.Forest(classes=True, trees=1, depth=1, importance="permutation", seed=SEED)
_SIZES_SQL = f"""SELECT *, CASE WHEN qty_sum > 150 THEN 'LARGE' WHEN qty_sum > 75 THEN 'MEDIUM' WHEN qty_sum > 0 THEN 'SMALL' ELSE 'EMPTY' END AS size
  FROM ({_STUMP_SQL})"""
_STUMP_TYPES = (("contains", "_cnt", "COUNT"), ("starts", "band", "MONEY"))


def _class_stumps_sql(source):
    """The final selection by stumps: the split with the largest Gini gain, then wrong votes on permuted held-out rows."""
    placed = _blocks_sql(source, STUMP_FIELDS, STUMP_FIELDS, range(1, _STUMP_RUNS)).replace(
        f"base AS (SELECT {ft.ORDER_KEY}, ", f"base AS (SELECT {ft.ORDER_KEY}, CASE size WHEN 'SMALL' THEN 'LITTLE' WHEN 'EMPTY' THEN 'LITTLE' ELSE size END AS label, ", 1
    )
    return f"""WITH {placed},
    inputs AS (SELECT run, block, pos, field, v, false AS is_shadow FROM vals CROSS JOIN runs
      UNION ALL SELECT run, block, pos, field, v, true FROM moved),
    tally AS (SELECT i.run, i.field, i.is_shadow, i.v, p.label, count(*) AS n FROM inputs i JOIN placed p ON p.block = i.block AND p.pos = i.pos
      WHERE (i.pos + i.run) % 3 <> 0 GROUP BY ALL),
    cuts AS (SELECT *, lead(v) OVER (PARTITION BY run, field, is_shadow ORDER BY v) AS nv FROM (SELECT DISTINCT run, field, is_shadow, v FROM tally)),
    sides AS (
      SELECT c.run, c.field, c.is_shadow, c.v, c.nv, t.label, coalesce(sum(n) FILTER (t.v <= c.v), 0) AS nl, coalesce(sum(n) FILTER (t.v > c.v), 0) AS nr
      FROM cuts c JOIN tally t ON t.run = c.run AND t.field = c.field AND t.is_shadow = c.is_shadow WHERE c.nv IS NOT NULL GROUP BY ALL),
    splits AS (
      SELECT run, {{'field': field, 'shadow': is_shadow, 'cut': (v + nv) / 2, 'low': arg_max(label, nl), 'high': arg_max(label, nr)}} AS g,
        sum(nl * nl) / sum(nl) + sum(nr * nr) / sum(nr) AS gain FROM sides GROUP BY run, field, is_shadow, v, nv),
    best AS (SELECT run, arg_max(g, gain) AS g FROM splits GROUP BY run),
    held AS (
      SELECT i.run, i.block, i.v, p.label, b.g,
        row_number() OVER (PARTITION BY i.run, i.block ORDER BY i.pos) - 1 AS spot, count(*) OVER (PARTITION BY i.run, i.block) AS m
      FROM inputs i JOIN best b ON b.run = i.run AND b.g.field = i.field AND b.g.shadow = i.is_shadow
      JOIN placed p ON p.block = i.block AND p.pos = i.pos WHERE (i.pos + i.run) % 3 = 0),
    turned AS (
      SELECT *, (spot + {_offset_sql("(run || '.held')", "CASE WHEN g.shadow THEN 'shadow_' || run || '_' || g.field ELSE g.field END", "m")}) % m AS other FROM held),
    won AS (
      SELECT a.run, any_value(a.g.field) AS field, any_value(a.g.shadow) AS is_shadow,
        avg(CAST(CASE WHEN b.v <= a.g.cut THEN a.g.low ELSE a.g.high END <> a.label AS INTEGER)
          - CAST(CASE WHEN a.v <= a.g.cut THEN a.g.low ELSE a.g.high END <> a.label AS INTEGER)) AS importance
      FROM turned a JOIN held b ON b.run = a.run AND b.block = a.block AND b.spot = a.other GROUP BY a.run),
    names(field, type) AS (VALUES {", ".join(f"('{f}', '{'COUNT' if '_cnt' in f else 'MONEY' if f == 'band' else 'OTHER'}')" for f in STUMP_FIELDS)}),
    hits AS (
      SELECT n.field, n.type, CASE WHEN NOT w.is_shadow AND w.field = n.field THEN w.importance ELSE 0 END AS importance,
        CASE WHEN NOT w.is_shadow AND w.field = n.field AND w.importance > 0 THEN 1 ELSE 0 END AS hit FROM names n CROSS JOIN won w)
    SELECT field, type, CASE sum(hit) WHEN 10 THEN 'Confirmed' WHEN 0 THEN 'Rejected' ELSE 'Tentative' END AS decision,
      round(median(importance), 6) AS median_imp, round(sum(hit) / 10, 6) AS norm_hits
    FROM hits GROUP BY field, type"""


def _final_stumps(spark, folder, rows=None):
    size = F.when(F.col("qty_sum") > 150, "LARGE").when(F.col("qty_sum") > 75, "MEDIUM").when(F.col("qty_sum") > 0, "SMALL").otherwise("EMPTY")
    listed = spark.createDataFrame(list(enumerate([ft.ORDER_KEY, *STUMP_FIELDS])), "position int, field string")
    found = flows.final_selection(
        _stump_table(spark, folder).withColumn("size", size), ft.ORDER_KEY, "size", listed, {"LITTLE": ["SMALL", "EMPTY"]}, rows, _STUMP_RUNS, _CLASS_STUMP,
        _STUMP_TYPES,
    )
    return found.select("field", "type", "decision", F.round("median_imp", 6).alias("median_imp"), F.round("norm_hits", 6).alias("norm_hits"))


@query("final_selection_stumps", _class_stumps_sql(_SIZES_SQL))
def final_selection_stumps(spark, folder):
    """Manifest, projection, merged classes, multiclass selection and taxonomy as one flow, by forests of one split."""
    return _final_stumps(spark, folder)


@query("filtered_selection_stumps", _class_stumps_sql(f"SELECT * FROM ({_SIZES_SQL}) WHERE ret_cnt > 0"))
def filtered_selection_stumps(spark, folder):
    """The same flow on the rows of one group."""
    return _final_stumps(spark, folder, F.col("ret_cnt") > 0)


# --- forests: no SQL twin ---

_FOREST = forests.Forest(trees=20, depth=5)
_CLASS_FOREST = forests.Forest(classes=True, trees=20, depth=5)
_WIDE = [n for n in NUMBERS if n != "open_cnt"]


@query("boruta_forest")
def boruta_forest(spark, folder):
    """All-relevant selection for a 0/1 target over all orders."""
    df = ft.order_features(spark, folder).withColumn("many_open", F.when(F.col("open_cnt") >= 3, 1).otherwise(0))
    return forests.all_relevant(df, ft.ORDER_KEY, "many_open", _WIDE, presets.FINAL_RUNS, _FOREST).fields


@query("boruta_multiclass")
def boruta_multiclass(spark, folder):
    """All-relevant selection for a class target, on the rows a filter keeps."""
    df = ft.order_features(spark, folder).where(F.col("ret_flg") == 1)
    size = F.when(F.col("qty_sum") > 150, "LARGE").when(F.col("qty_sum") > 75, "MEDIUM").otherwise("SMALL")
    fields = [n for n in NUMBERS if n not in ("qty_sum", "ret_flg")]
    found = forests.all_relevant(df.withColumn("size", size), ft.ORDER_KEY, "size", fields, presets.FILTERED_RUNS, _CLASS_FOREST)
    return found.fields


@query("boruta_chunks")
def boruta_chunks(spark, folder):
    """Taxonomy, column chunks, forests per target and chunk, and the combined best list."""
    df = ft.order_features(spark, folder)
    flags = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM"}
    flagged = df.select("*", *[F.when(F.col("o_orderpriority") == c, 1).otherwise(0).alias(n) for n, c in flags.items()])
    return flows.ranked_selection(
        flagged, ft.ORDER_KEY, list(flags), NUMBERS, chunk_size=7, max_runs=presets.CHUNK_RUNS, best=presets.BEST_PER_TARGET, forest=_FOREST,
        rules=(("contains", "_sum", "SUM"), ("contains", "_cnt", "COUNT")),
    )


@query("boruta_permutation")
def boruta_permutation(spark, folder):
    """All-relevant selection for a 0/1 target by permutation importance on held-out rows."""
    df = ft.order_features(spark, folder).withColumn("many_open", F.when(F.col("open_cnt") >= 3, 1).otherwise(0))
    forest = replace(_FOREST, importance="permutation")
    return forests.all_relevant(df, ft.ORDER_KEY, "many_open", _WIDE, presets.FINAL_RUNS, forest).fields


@query("rfe_forest")
def rfe_forest(spark, folder):
    """Recursive elimination for a 0/1 target: scores per subset size."""
    df = ft.order_features(spark, folder).withColumn("many_open", F.when(F.col("open_cnt") >= 3, 1).otherwise(0))
    return forests.recursive_elimination(
        df, ft.ORDER_KEY, "many_open", _WIDE, presets.SUBSET_SIZES_CODES, presets.RESAMPLE_FOLDS, presets.RESAMPLE_REPEATS, _FOREST
    ).profile


@query("rfe_predictors")
def rfe_predictors(spark, folder):
    """The fields recursive elimination keeps for a class target."""
    df = ft.order_features(spark, folder)
    size = F.when(F.col("qty_sum") > 150, "LARGE").when(F.col("qty_sum") > 75, "MEDIUM").otherwise("SMALL")
    fields = [n for n in NUMBERS if n not in ("qty_sum", "line_cnt", "has_line_flg")]
    found = forests.recursive_elimination(
        df.withColumn("size", size), ft.ORDER_KEY, "size", fields, presets.SUBSET_SIZES_ALL, presets.RESAMPLE_FOLDS, presets.RESAMPLE_REPEATS, _CLASS_FOREST
    )
    return spark.createDataFrame(list(enumerate(found.selected, 1)), "rank int, field string")
