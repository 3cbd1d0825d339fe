"""Run registered queries in Spark and their SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, ".")

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


_SPARK_KIND = {"int": "int32", "bigint": "int64", "double": "double", "string": "string",
               "boolean": "bool", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
               "smallint": "int16", "float": "float"}
_DUCK_KIND = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "VARCHAR": "string",
              "BOOLEAN": "bool", "TIMESTAMP": "timestamp", "SMALLINT": "int16", "FLOAT": "float"}


def _kinds(df, res) -> tuple[dict, dict]:
    sk = {f.name: _SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in df.schema.fields}
    dk = {d[0]: _DUCK_KIND.get(str(d[1]), str(d[1])) for d in res.description}
    return sk, dk


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(rows)} rows ({t1 - t0:.2f}s)"
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows_raw = res.fetchall()
    if sorted(ocols) != sorted(cols):
        return False, f"columns differ: spark={sorted(cols)} oracle={sorted(ocols)}"
    sk, dk = _kinds(df, res)
    if sk != dk:
        diff = {c: (sk.get(c), dk.get(c)) for c in sk if sk.get(c) != dk.get(c)}
        return False, f"types differ (spark, oracle): {diff}"
    idx = [ocols.index(c) for c in sorted(cols)]
    orows = [tuple(_norm(r[i]) for i in idx) for r in orows_raw]
    if len(rows) != len(orows):
        return False, f"row count spark={len(rows)} oracle={len(orows)}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(rows, key=key), sorted(orows, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}"
    return True, f"{len(rows)} rows match ({t1 - t0:.2f}s)"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from sightline.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(f"{'OK ' if ok else 'BAD'} {name}: {msg}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
