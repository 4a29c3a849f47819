"""Run registered queries beside their SQL on the same parquet tables and compare the values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    """One spelling for values both engines may type differently."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, name, fn, sql, folder):
    """None when both agree, else a short account of the difference."""
    got = fn(spark, folder)
    columns = got.columns
    mine = rows_of(columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return None, len(mine)
    relation = connection.sql(sql)
    theirs_columns = list(relation.columns)
    theirs = rows_of(theirs_columns, relation.fetchall())
    if sorted(columns) != sorted(theirs_columns):
        return f"columns {sorted(columns)} / {sorted(theirs_columns)}", len(mine)
    if mine == theirs:
        return None, len(mine)
    a, b = [r for r in mine if r not in set(theirs)], [r for r in theirs if r not in set(mine)]
    return f"rows {len(mine)} / {len(theirs)}; only ours {a[:2]}; only theirs {b[:2]}", len(mine)


if __name__ == "__main__":
    from dispatchery.plans import load
    from dispatchery.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    session = local_session()
    session.sparkContext.setLogLevel("OFF")
    loaded, connection = load(), duck(folder)
    bad = 0
    for name, fn in sorted(loaded.queries.items()):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            problem, n = compare(session, connection, name, fn, loaded.oracles.get(name), folder)
        except Exception as error:  # report every query, not only the first failure
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:32s} rows={n:<7d} {time.time() - started:6.2f}s {'' if name in loaded.oracles else '(no sql)'} {problem or ''}"[:1500], flush=True)
    print("failures:", bad)
