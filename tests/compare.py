"""Run registered queries beside their SQL and report the differences (also usable from a shell)."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def _rows(records, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(_plain(r[i]) for i in at) for r in records), key=repr)


def differences(spark, con, sf_dir, run, sql):
    """A list of messages; empty when both sides agree in names, kinds and values."""
    frame = run(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    cursor = con.execute(sql)
    names, want = [c[0] for c in cursor.description], cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} and {sorted(names)}"]
    order = sorted(names)
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    a, b = _rows(got, list(frame.columns), order), _rows(want, names, order)
    out = []
    loose = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    for name, kind in frame.dtypes:
        if loose.get(kind) != kinds[name]:
            out.append(f"{name}: {kind} and {kinds[name]}")
    if len(a) != len(b):
        out.append(f"rows {len(a)} and {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        out.append(f"{len(wrong)} differ; first: {order} {wrong[0]}")
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from groundwork import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = session.build("compare", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            found = differences(spark, con, sf, run, oracles[name]) if name in oracles else [f"rows only: {run(spark, sf).count()}"]
        except Exception as error:  # report and go on
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
