"""Runs a query and its DuckDB statement on the same tables and compares the rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        where = path if os.path.isfile(path) else f"{path}/*.parquet"
        if glob.glob(where):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(con, df, sql):
    got = rows(df.columns, df.collect())
    made = con.sql(sql)
    want = rows(made.columns, made.fetchall())
    assert sorted(df.columns) == sorted(made.columns), (df.columns, made.columns)
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (len(bad), bad[:3])
