"""Run registered queries against their DuckDB oracle and compare.

Comparison: column names (sorted), a coarse type class per column
(int / float / string / other), row count, and the multiset of rows with
floats rounded to 6 decimals (``--exact``: floats compared bit for bit).
Usable as a script:

    python tests/oracle_check.py [--exact] /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cls_spark(dt) -> str:
    n = dt.typeName()
    if n in ("integer", "long", "short", "byte"):
        return f"int:{n}"
    if n in ("double", "float", "decimal"):
        return "float"
    if n == "string":
        return "string"
    return n


_DUCK_INT = {"INTEGER": "int:integer", "BIGINT": "int:long", "SMALLINT": "int:short",
             "TINYINT": "int:byte", "HUGEINT": "int:huge"}


def _cls_duck(t: str) -> str:
    t = t.upper()
    if t in _DUCK_INT:
        return _DUCK_INT[t]
    if t in ("DOUBLE", "FLOAT"):
        return "float"
    if t.startswith("DECIMAL"):
        return "decimal"
    if t == "VARCHAR":
        return "string"
    return t.lower()


EXACT = False


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return (v if EXACT else round(v, 6)) + 0.0
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_schema = {f.name: _cls_spark(f.dataType) for f in sdf.schema.fields}
    s_rows = sdf.collect()
    t_spark = time.time() - t0
    rel = con.sql(sql)
    d_schema = {c: _cls_duck(str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_schema) != sorted(d_schema):
        problems.append(f"columns spark={sorted(s_schema)} duck={sorted(d_schema)}")
    else:
        for c in s_schema:
            if s_schema[c] != d_schema[c]:
                problems.append(f"type {c}: spark={s_schema[c]} duck={d_schema[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        cols = sorted(s_schema)
        sidx = [sdf.columns.index(c) for c in cols]
        didx = [rel.columns.index(c) for c in cols]
        a = sorted((tuple(_norm(r[i]) for i in sidx) for r in s_rows), key=_key)
        b = sorted((tuple(_norm(r[i]) for i in didx) for r in d_rows), key=_key)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diff}")
    return problems, t_spark


def main(argv):
    global EXACT
    if "--exact" in argv:
        EXACT = True
        argv = [a for a in argv if a != "--exact"]
    sys.path.insert(0, ".")
    from pulsepanel import get_spark
    from pulsepanel.plans.catalog import oracle_sql, queries

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(oracle_sql())
    spark = get_spark()
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for n in names:
        if n not in os_:
            print(f"SKIP {n} (no oracle)")
            continue
        try:
            problems, t = compare(spark, n, qs[n], os_[n], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            problems, t = [f"error {type(e).__name__}: {str(e)[:400]}"], 0.0
        status = "OK  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{status} {n} ({t:.1f}s) {'; '.join(problems)}", flush=True)
    print(f"{bad} failing of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
