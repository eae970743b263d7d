"""Spark results beside DuckDB's on the same tables."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def same(spark_df, connection, sql):
    """Assert equal columns and equal rows, in whatever order."""
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(spark_df.columns)
    order = sorted(names)
    wanted = [tuple(plain(dict(zip(names, row))[c]) for c in order) for row in found.fetchall()]
    got = [tuple(plain(row[c]) for c in order) for row in spark_df.collect()]
    key = lambda row: tuple((v is None, str(type(v) is bool), repr(v)) for v in row)
    norm = lambda rows: sorted((tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows), key=key)
    assert norm(got) == norm(wanted)
