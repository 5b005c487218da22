"""Run registered queries against their SQL twins: ``python tests/compare.py [folder] [name ...]``."""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def connect(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def kinds(rows):
    return [{type(v).__name__ for v in col if v is not None} for col in zip(*rows)] if rows else []


def compare(spark, con, sf, name, query, sql):
    """None when equal, else what differs."""
    found = query(spark, sf)
    ours = rows_of(found.columns, [tuple(r) for r in found.collect()])
    if sql is None:
        return None
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    if ours != theirs:
        return "values " + str(next((a, b) for a, b in zip(ours, theirs) if a != b))
    if kinds(ours) != kinds(theirs):
        return f"types {kinds(ours)} / {kinds(theirs)}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from ledgerloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sqls = build_session("compare", f"local[{os.environ.get('COMPARE_CPUS', '8')}]"), connect(sf), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if wanted and name not in wanted and not any(w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf, name, query, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
