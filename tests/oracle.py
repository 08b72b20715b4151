"""Compare registered queries with their SQL on the same tables.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import signal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v.is_integer() and abs(v) < 1e15 else v
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


def compare(spark, con, name, sf_dir):
    """(verdict, detail, seconds): exact, near (floats within 1e-6), or a mismatch."""
    import __spark_entry__ as entry

    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows", f"{len(got)} rows", seconds
    cur = con.execute(sql)
    want = cur.fetchall()
    cols_w = [d[0] for d in cur.description]
    cg, rg = rows_of(df.columns, got)
    cw, rw = rows_of(cols_w, want)
    if cg != cw:
        return "COLUMNS", f"{cg} vs {cw}", seconds
    if len(rg) != len(rw):
        return "COUNT", f"{len(rg)} vs {len(rw)}", seconds
    if rg == rw:
        return "exact", f"{len(rg)} rows", seconds
    bad = [(a, b) for a, b in zip(rg, rw) if not all(close(x, y) for x, y in zip(a, b))]
    if not bad:
        diff = next((a, b) for a, b in zip(rg, rw) if a != b)
        return "near", f"{len(rg)} rows, e.g. {diff}", seconds
    return "VALUES", f"{len(bad)} of {len(rg)}: {bad[0]}", seconds


def main():
    import __spark_entry__ as entry
    from tutorloom.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError("400 s passed")))
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    names = [n for n in entry.queries() if not args or any(n.startswith(a) for a in args)]
    counts: dict[str, int] = {}
    for n in names:
        try:
            signal.alarm(400)
            verdict, detail, seconds = compare(spark, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001
            spark.sparkContext.cancelAllJobs()
            verdict, detail, seconds = "ERROR", str(e).split("\n")[0][:400], 0.0
        signal.alarm(0)
        counts[verdict] = counts.get(verdict, 0) + 1
        if verdict != "exact" or seconds > 5 or len(names) < 12:
            print(f"{verdict:8} {n:45} {seconds:6.2f}s {detail[:700]}", flush=True)
    print(counts)


if __name__ == "__main__":
    main()
