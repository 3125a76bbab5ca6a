"""Run registered queries against their SQL on one scale factor: python tools/check.py <sf_dir> [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from glossweave.plans import load_catalog  # noqa: E402
from glossweave.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(normal(r[i]) for i in order) for r in data)


def compare(spark, con, q, root):
    start = time.time()
    df = q.run(spark, root)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if not q.sql:
        return True, len(got[1]), took, "rows only"
    cur = con.execute(q.sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return True, len(got[1]), took, "match"
    if got[0] != want[0]:
        return False, len(got[1]), took, f"columns {got[0]} != {want[0]}"
    a, b = set(got[1]), set(want[1])
    return False, len(got[1]), took, f"rows {len(got[1])} vs {len(want[1])}; spark only {sorted(a - b)[:2]!r:.600}; sql only {sorted(b - a)[:2]!r:.600}"


if __name__ == "__main__":
    root, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    bad = 0
    for name, q in load_catalog().items():
        if names and name not in names:
            continue
        try:
            ok, n, took, note = compare(spark, con, q, root)
        except Exception as e:  # report and go on with the next query
            ok, n, took, note = False, 0, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {n:8d} rows {took:6.2f}s {note}", flush=True)
    print(f"{bad} failing")
    sys.exit(bool(bad))
