"""Compares a Spark result with its SQL twin in DuckDB: columns by name, types, rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) and glob.glob(path + '/*') else path}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    if hasattr(x, "tolist"):
        return _value(x.tolist())
    if isinstance(x, dict):
        return tuple(sorted((k, _value(v)) for k, v in x.items()))
    return x


def rows(table, names) -> list[tuple]:
    cols = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(_value(v) for v in r) for r in zip(*cols)), key=repr)


_SAME = {"string": "text", "large_string": "text", "double": "double", "float": "float", "int64": "int64", "int32": "int32", "bool": "bool"}


def problems(df, sql: str, con) -> list[str]:
    got, want = df.toArrow(), con.execute(sql).to_arrow_table()
    out = []
    a, b = sorted(got.column_names), sorted(want.column_names)
    if a != b:
        return [f"columns {a} against {b}"]
    for n in a:
        ta, tb = (_SAME.get(str(t.schema.field(n).type), str(t.schema.field(n).type)) for t in (got, want))
        if ta != tb:
            out.append(f"type of {n}: {ta} against {tb}")
    ra, rb = rows(got, a), rows(want, a)
    if ra != rb:
        diff = [(x, y) for x, y in zip(ra, rb) if x != y][:2]
        out.append(f"{len(ra)} rows against {len(rb)}; {str(diff)[:400]}")
    return out
