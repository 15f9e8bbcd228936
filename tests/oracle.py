"""Compares queries with their SQL as the driver does: names, row counts and values in any order."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, Decimal, float)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    return str(v)


def difference(spark, sf, name, f, sql):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = f(spark, sf)
    cols = sorted(got.columns)
    a = [tuple(norm(x) for x in r) for r in got.select(cols).collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} / {sorted(rel.columns)}"
    b = [tuple(norm(x) for x in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()]
    a.sort(key=repr)
    b.sort(key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)}"
    return None if a == b else f"values {[x for x in zip(a, b, strict=True) if x[0] != x[1]][:2]}"
