"""Runs a query's SQL in DuckDB over the given tables and compares the rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def kind(name):
    name = name.lower()
    for k, names in {"int": ("bigint", "int", "long"), "float": ("double",), "str": ("varchar", "string"), "bool": ("bool",)}.items():
        if any(name.startswith(n) for n in names):
            return k
    return name


def compare(df, sql, c):
    """None if rows and kinds of columns agree, else what differs."""
    rel = c.sql(sql)
    ours, theirs = sorted(df.columns), sorted(rel.columns)
    if ours != theirs:
        return f"columns {ours} and {theirs}"
    kinds = [(n, kind(dict(df.dtypes)[n]), kind(str(dict(zip(rel.columns, rel.types))[n]))) for n in ours]
    if wrong := [k for k in kinds if k[1] != k[2]]:
        return f"kinds {wrong}"
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    a = sorted((tuple(plain(r[n]) for n in ours) for r in df.collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in rel.select(*[f'"{n}"' for n in ours]).fetchall()), key=key)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only ours {sorted(sa - sb, key=key)[:3]}; only SQL {sorted(sb - sa, key=key)[:3]}"
