"""Rows of a query and of its oracle, in a form that can be compared."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def assert_same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == names
    at = [relation.columns.index(n) for n in names]
    kinds = [(n, KINDS.get(df.schema[n].dataType.simpleString(), "?"), str(relation.types[i])) for n, i in zip(names, at, strict=True)]
    assert all(a == b for _, a, b in kinds), kinds
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    want = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
