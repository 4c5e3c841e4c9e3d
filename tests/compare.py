"""Rows of a Spark query and of its SQL in DuckDB, in one canonical form."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    return v if v is None else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([cell(r[k]) for k in order]) for r in rows)


def same(df, relation) -> tuple[list, list]:
    return canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(relation.columns, relation.fetchall())
