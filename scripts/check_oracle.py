"""Run catalog queries in Spark and their SQL oracles in DuckDB on the same
Parquet tables; compare column names, row counts and values.

usage: python scripts/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("STRICT") else float(f"{v:.10g}")
    if hasattr(v, "item"):
        return v.item()
    return v


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        problems.append(f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}")
        return problems
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} vs {len(duck_rows)}")
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} differing rows, first: {bad[0]}")
    return problems


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    from latebound.plans import ORACLE_SQL, QUERIES
    from latebound.session import local_session

    spark = local_session(8)
    con = duck(sf_dir)
    failures = 0
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        if name not in ORACLE_SQL:
            print(f"{name:32s} no oracle")
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        rel = con.execute(ORACLE_SQL[name])
        dcols = [d[0] for d in rel.description]
        dtypes = {d[0]: str(d[1]) for d in rel.description}
        drows = rel.fetchall()
        probs = compare(rows, list(types), drows, dcols)
        tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
        tdiff = {c: (types[c], dtypes.get(c)) for c in types if tmap.get(types[c]) != dtypes.get(c)}
        if tdiff:
            probs.append(f"types {tdiff}")
        failures += bool(probs)
        status = "OK " if not probs else "BAD"
        print(f"{name:32s} {status} rows={len(rows):6d} spark={t1 - t0:5.1f}s " + "; ".join(probs), flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
