"""Compares a query's rows with those of its SQL in DuckDB."""

import decimal
import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


def assert_same(spark, query, sql, folder=SMALL):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    wanted = con.execute(sql)
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, wanted.fetchall())
