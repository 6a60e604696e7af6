"""Compare the registered queries with their SQL twins: ``python tests/check.py [folder] [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def twin_rows(folder: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, [str(d[1]) for d in found.description], found.fetchall()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def differences(df, folder: str, sql: str) -> str | None:
    """None when names and rows agree, otherwise what differs."""
    names, types, expected = twin_rows(folder, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(df.columns)
    sort = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    got = sort([tuple(_plain(r[c]) for c in order) for r in df.collect()])
    at = [names.index(c) for c in order]
    want = sort([tuple(_plain(r[i]) for i in at) for r in expected])
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if any(repr(a) != repr(b) for a, b in zip(g, w)):
            return f"{dict(zip(order, g))} != {dict(zip(order, w))}"
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    spark_types = [kinds.get(df.schema[c].dataType.simpleString(), "?") for c in order]
    twin_types = [types[i] for i in at]
    wrong = [(c, a, b) for c, a, b in zip(order, spark_types, twin_types) if a != "?" and a != b]
    return f"types differ: {wrong}" if wrong else None


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from broadloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    twins, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            said = differences(df, folder, twins[name]) if name in twins else f"rows only: {df.count()}"
            ok = said is None or name not in twins
        except Exception as error:  # noqa: BLE001
            said, ok = f"{type(error).__name__}: {str(error)[:600]}", False
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {said or ''}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(min(1, main(args[0], args[1:])))
