"""Run registered queries next to their reference SQL: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_norm(r[i]) for i in order) for r in rows])


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows-only rows={len(rows)}", took, 0.0, True
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t
    a, b = table(df.columns, rows), table(cols, want)
    if a == b:
        return f"match rows={len(rows)}", took, sql_took, True
    note = f"MISMATCH spark={len(rows)} sql={len(want)} cols {a[0]} {b[0]}"
    left, right = set(a[1]) - set(b[1]), set(b[1]) - set(a[1])
    note += f"\n    spark only {len(left)}: {sorted(left)[:3]}\n    sql only {len(right)}: {sorted(right)[:3]}"
    return note, took, sql_took, False


def main(argv: list[str]) -> int:
    from checks.queries import QUERIES, SQL
    from firegrid.session import build_session

    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names:
        try:
            note, took, sql_took, ok = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            note, took, sql_took, ok = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0, 0.0, False
        if not ok:
            bad.append(name)
        print(f"{name:34s} {took:6.1f}s {sql_took:6.1f}s {note}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
