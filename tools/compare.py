"""Run queries on Spark and their SQL on DuckDB, and compare rows.

    python tools/compare.py /root/testdata/sf0.01 [name ...]   (a name may be a module: @joins)
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def kinds(values):
    return [type(v).__name__ for v in values]


def compare(spark, con, fn, sql, folder):
    """``(ok, message, Spark row count)``"""
    df = fn(spark, folder)
    names = df.columns
    got = rows(names, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, "rows only", len(got)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows(want_names, cur.fetchall())
    if sorted(names) != sorted(want_names):
        return False, f"columns {sorted(names)} / {sorted(want_names)}", len(got)
    types = dict(zip(names, [f.dataType.simpleString() for f in df.schema.fields]))
    duck_types = {d[0]: str(d[1]).lower() for d in cur.description}
    note = []
    for n in sorted(names):
        a, b = types[n], duck_types[n]
        same = {"int": "integer", "string": "varchar", "timestamp_ntz": "timestamp", "float": "float"}.get(a, a)
        if same != b and not (a.startswith("decimal") and b.startswith("decimal")):
            note.append(f"{n}:{a}/{b}")
    if got == want:
        return True, " ".join(note), len(got)
    diff = next(((g, w) for g, w in zip(got, want) if g != w), None)
    return False, f"{len(got)} rows against {len(want)}; first difference {diff}", len(got)


def main(folder, wanted):
    from loomwork.catalog import ORACLE, QUERIES
    from loomwork.session import build_session
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    names = [n for n in QUERIES if not wanted or n in wanted
             or any(w[0] == "@" and QUERIES[n].__closure__[0].cell_contents.__module__.endswith("." + w[1:])
                    for w in wanted)]
    for n in names:
        start = time.time()
        try:
            ok, text, count = compare(spark, con, QUERIES[n], ORACLE.get(n), folder)
        except Exception as e:  # noqa: BLE001
            ok, text, count = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        bad += not ok
        flag = "ok  " if ok else "FAIL"
        if not ok or text or count == 0 or time.time() - start > 3:
            print(f"{flag} {n:24s} {count:7d} rows {time.time() - start:5.1f}s {text}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
