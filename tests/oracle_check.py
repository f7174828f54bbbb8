"""Compare registered queries with their SQL oracles.

    python tests/oracle_check.py [scale] [name-prefix ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("LECTERN_DATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


def connect(directory):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{directory}/{table}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "as_tuple"):
        return ("decimal", str(value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(frame, con, sql):
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        missing = [r for r in want[1] if r not in set(got[1])][:2] if len(want[1]) < 5000 else ""
        extra = [r for r in got[1] if r not in set(want[1])][:2] if len(got[1]) < 5000 else ""
        return f"rows {len(got[1])} != {len(want[1])}; only oracle {missing}; only spark {extra}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b or any(type(x) is not type(y) for x, y in zip(a, b))]
    if bad:
        return f"{len(bad)} rows differ, first {str(bad[0])[:1500]}"
    return None


def main():
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    from lectern.plans.catalog import ORACLES, QUERIES
    from lectern.session import local_session

    spark = local_session("oracle-check", 8)
    directory = f"{DATA}/sf{scale}"
    con = connect(directory)
    failed = []
    for name, run in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            frame = run(spark, directory)
            if name in ORACLES:
                problem = compare(frame, con, ORACLES[name])
            else:
                problem = None if frame.count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    spark.stop()


if __name__ == "__main__":
    main()
