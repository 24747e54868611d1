"""Run registered queries next to their DuckDB oracles and compare them value by value."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def kind(name: str) -> str:
    """Type family, as Spark and DuckDB name types differently."""
    name = name.lower()
    for family, words in {
        "ts": ("timestamp",), "date": ("date",), "bool": ("bool",), "int": ("int",),
        "float": ("double", "float"), "text": ("string", "varchar"),
    }.items():
        if any(w in name for w in words):
            return family
    return name


def compare(spark, con, name, entry, folder):
    """(problem or None, rows, spark seconds, oracle seconds)."""
    begin = time.time()
    df = entry.run(spark, folder)
    got = df.collect()
    middle = time.time()
    if not entry.sql:
        return (None if df.columns else "no columns"), len(got), middle - begin, 0.0
    out = con.execute(entry.sql)
    names = [d[0] for d in out.description]
    types = {d[0]: kind(str(d[1])) for d in out.description}
    want = out.fetchall()
    done = time.time()
    problem = None
    mine = {n: kind(t) for n, t in df.dtypes}
    if sorted(df.columns) != sorted(names):
        problem = f"columns {sorted(df.columns)} vs {sorted(names)}"
    elif mine != types:
        problem = f"types {[(n, mine[n], types[n]) for n in mine if mine[n] != types[n]]}"
    else:
        a, b = _rows(df.columns, got), _rows(names, want)
        if a != b:
            extra = [r for r in a if r not in set(b)][:2]
            missing = [r for r in b if r not in set(a)][:2]
            problem = f"{len(a)} vs {len(b)} rows; {sorted(names)}\n  spark {extra}\n  sql   {missing}"
    return problem, len(got), middle - begin, done - middle


def main(argv):
    sys.path.insert(0, ROOT)
    from eventloom.registry import load_all
    from eventloom.session import build_session

    folder = argv[0]
    picked = argv[1:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                         "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, entry in load_all().items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        try:
            problem, rows, mine, theirs = compare(spark, con, name, entry, folder)
        except Exception as error:  # noqa: BLE001
            problem, rows, mine, theirs = f"{type(error).__name__}: {str(error)[:900]}", -1, 0, 0
        failed += problem is not None
        flag = "FAIL" if problem else ("ok  " if entry.sql else "rows")
        print(f"{flag} {name:40s} {rows:7d} rows {mine:6.2f}s sql {theirs:5.2f}s", flush=True)
        if problem:
            print("  " + problem, flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
