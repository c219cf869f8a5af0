"""Comparison of a Spark result with DuckDB's result of the oracle's SQL over the same files."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return ("decimal", float(v)) if isinstance(v, Decimal) else v


def compare(df, con, sql):
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    got = sorted((tuple(_plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    assert got == wanted
