"""Run a registered query on Spark and its DuckDB twin, and compare results.

Columns are sorted by name, doubles rounded to 6 places and rows compared as
multisets (order-insensitive), which is how the correctness gate compares.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

from routelens.sources.tables import TABLES


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, Decimal) and v == v.to_integral_value():
        return int(v)              # money totals, exact beyond what a double holds
    if hasattr(v, "__float__") and not isinstance(v, (int, bool)):
        return round(float(v), 6) + 0.0
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], [cols[i] for i in order]


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_mismatches(sdf, con, sql):
    """Columns whose Spark type and DuckDB type differ (by name)."""
    d_types = {c: str(t) for c, t in zip(con.sql(sql).columns, con.sql(sql).types)}
    out = []
    for c, t in sdf.dtypes:
        want = SPARK_TO_DUCK.get(t, t.upper())
        got = d_types.get(c)
        if got is not None and got != want and not (t.startswith("array") and got.endswith("[]")):
            out.append(f"{c}: spark {t} duck {got}")
    return out


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    types = type_mismatches(sdf, con, sql)
    s_rows, s_names = rows_of(s_cols, sdf.collect())
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows, d_names = rows_of(d_cols, rel.fetchall())
    problems = []
    if types:
        problems.append("types differ: " + "; ".join(types))
    if s_names != d_names:
        problems.append(f"columns differ: spark={s_names} duck={d_names}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        cs, cd = Counter(s_rows), Counter(d_rows)
        if cs != cd:
            only_s = list((cs - cd).elements())[:3]
            only_d = list((cd - cs).elements())[:3]
            problems.append(f"values differ: spark-only={only_s} duck-only={only_d}")
    return len(s_rows), problems
