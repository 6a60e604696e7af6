"""SQL for the feature tables of :mod:`broadloom.plans.features`, shared by the SQL twins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from broadloom.plans.features import EVENT_TYPES, ORDER_KEY, ORDER_NUMBERS, WIDE_CELLS, WIDE_FIELDS

ORDER_FEATURES = """
SELECT o.o_orderkey, o.o_orderpriority, o.o_orderstatus, c.c_mktsegment, n.n_name, r.r_name,
       o.o_totalprice, c.c_acctbal,
       l.line_cnt, l.qty_sum, l.price_sum, l.disc_sum, l.tax_sum, l.net_sum, l.ret_cnt, l.open_cnt, l.qty_max,
       CASE WHEN l.ret_cnt > 0 THEN 1 ELSE 0 END AS ret_flg,
       CASE WHEN l.l_orderkey IS NULL THEN 0 ELSE 1 END AS has_line_flg
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (
  SELECT l_orderkey, count(*) AS line_cnt, sum(l_quantity) AS qty_sum, sum(l_extendedprice) AS price_sum,
         sum(l_discount) AS disc_sum, sum(l_tax) AS tax_sum,
         sum(l_extendedprice * (1 - l_discount)) AS net_sum,
         count(*) FILTER (WHERE l_returnflag = 'R') AS ret_cnt,
         count(*) FILTER (WHERE l_linestatus = 'O') AS open_cnt,
         max(l_quantity) AS qty_max
  FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
"""

CUSTOMER_FEATURES = """
SELECT c.c_custkey, c.c_mktsegment, c.c_nationkey, c.c_acctbal,
       count(o.o_orderkey) AS all_order_cnt,
       sum(o.o_totalprice) AS all_rev_sum,
       sum(CASE WHEN o.o_orderpriority = '1-URGENT' THEN o.o_totalprice END) AS p1_rev_sum,
       sum(CASE WHEN o.o_orderpriority = '2-HIGH' THEN o.o_totalprice END) AS p2_rev_sum,
       sum(CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN o.o_totalprice END) AS p3_rev_sum,
       max(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f_flg,
       max(CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p_flg
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey, c.c_mktsegment, c.c_nationkey, c.c_acctbal
"""


def _trend(kind: str) -> str:
    half = "count(*) FILTER (WHERE event_type = '{0}' AND day(ts) {1} 15)"
    late, early = half.format(kind, ">"), half.format(kind, "<=")
    return f"CASE WHEN {late} > {early} THEN 'U' WHEN {late} < {early} THEN 'D' ELSE 'NULL' END AS \"{kind}_TREND_CATG\""


EVENT_TRENDS = f"SELECT user_id, {', '.join(_trend(t) for t in EVENT_TYPES)} FROM events GROUP BY user_id"


def _cell(cell: str) -> str:
    flag, status, line = cell.split("_")
    rows = f"FILTER (WHERE l_returnflag = '{flag}' AND l_linestatus = '{status}' AND l_linenumber = {line})"
    return (
        f"sum(l_quantity) {rows} AS {cell}_qty_sum, nullif(count(*) {rows}, 0) AS {cell}_line_cnt, "
        f"sum(l_extendedprice) {rows} AS {cell}_price_sum, max(l_discount) {rows} AS {cell}_disc_max"
    )


PART_FEATURES = f"SELECT l_partkey, {', '.join(_cell(c) for c in WIDE_CELLS)} FROM lineitem GROUP BY l_partkey"


def listed(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def rounded(names: Iterable[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def pairs(source: str, fields: Sequence[str], key: str = ORDER_KEY) -> str:
    """Common table expressions ``src`` and ``pairs(x, x_ord, y, y_ord, r, n)`` over every pair of fields."""
    cells = " UNION ALL ".join(
        f"SELECT {key} AS k, {i} AS ord, '{f}' AS field, CAST({f} AS DOUBLE) AS v FROM src WHERE {f} IS NOT NULL"
        for i, f in enumerate(fields)
    )
    return f"""src AS ({source}), cells AS ({cells}),
pairs AS (
  SELECT a.field AS x, a.ord AS x_ord, b.field AS y, b.ord AS y_ord,
         CASE WHEN count(*) >= 2
              THEN covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) END AS r,
         count(*) AS n
  FROM cells a JOIN cells b ON a.k = b.k AND a.ord < b.ord
  GROUP BY a.field, a.ord, b.field, b.ord)"""


def wide_pairs() -> str:
    """Like :func:`pairs` over the part features."""
    return pairs(PART_FEATURES, WIDE_FIELDS, "l_partkey")


def target_pairs(source: str, fields: Sequence[str], targets: Sequence[str], key: str = ORDER_KEY) -> str:
    """``src`` and ``pairs(x, x_ord, y, y_ord, r)`` of fields by targets."""
    rows = []
    for j, t in enumerate(targets):
        for i, f in enumerate(fields):
            a, b = f"CAST({f} AS DOUBLE)", f'CAST("{t}" AS DOUBLE)'
            rows.append(
                f"SELECT '{f}' AS x, {i} AS x_ord, '{t}' AS y, {j} AS y_ord, "
                f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS r "
                f'FROM src WHERE {f} IS NOT NULL AND "{t}" IS NOT NULL'
            )
    return f"src AS ({source}), pairs AS ({' UNION ALL '.join(rows)})"


def verdicts(strength: float = 0.85, signed: float | None = None, fields: Sequence[str] = tuple(ORDER_NUMBERS)) -> str:
    """``knock`` and ``verdicts(field, ordinal, knocked_out_by, r, verdict)`` on top of ``pairs``."""
    cut = f"abs(r) >= {strength}" + (f" AND r >= {signed}" if signed is not None else "")
    catalog = ", ".join(f"({i}, '{f}')" for i, f in enumerate(fields))
    return f"""catalog(ordinal, field) AS (VALUES {catalog}),
knock AS (
  SELECT y AS field, x AS knocked_out_by, r FROM (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY x) AS rn FROM pairs WHERE {cut}) WHERE rn = 1),
verdicts AS (
  SELECT c.field, c.ordinal, k.knocked_out_by, k.r, CASE WHEN k.r IS NOT NULL THEN 'DROP' ELSE 'KEEP' END AS verdict
  FROM catalog c LEFT JOIN knock k ON c.field = k.field)"""
