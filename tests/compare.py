"""Rows of Spark and of DuckDB in one form."""

import datetime
import math
import os
from collections import Counter

import duckdb


def norm(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(map(norm, v.values()))
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return f"{type(v).__name__}:{v}"


def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    ours = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
