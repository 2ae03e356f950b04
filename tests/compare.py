"""Run every registered query and its SQL statement side by side.

Usage: python tests/compare.py [sf] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    """One comparable form per value; types must agree except for integer and float widths."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return f"f:{value!r}" if value != 0 else "f:0.0"
    if isinstance(value, decimal.Decimal):
        return f"d:{value}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return f"t:{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return f"s:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, plan, sql, sf_dir):
    start = time.time()
    df = plan(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return f"ROWS  {name}: {len(got)} rows, {took:.2f}s", True
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"FAIL  {name}: columns {sorted(df.columns)} != {sorted(want_cols)}", False
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a == b:
        return f"OK    {name}: {len(a)} rows, {took:.2f}s", bool(a)
    sa, sb = set(a), set(b)
    head = f"FAIL  {name}: {len(a)} vs {len(b)} rows, {took:.2f}s; cols {sorted(df.columns)}"
    return head + f"\n   spark only {sorted(sa - sb)[:3]}\n   sql only   {sorted(sb - sa)[:3]}", False


def main(argv):
    import __spark_entry__ as entry
    from cashlens.session import get_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = get_session(8), connect(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or plans:
        try:
            line, ok = compare(spark, con, name, plans[name], sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            line, ok = f"ERROR {name}: {str(error)[:1500]}", False
        bad += not ok
        print(line, flush=True)
    print(f"{bad} not equal or empty")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
