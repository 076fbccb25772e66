"""Runs a query in Spark and its SQL in DuckDB over the same files."""

import os

import duckdb


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def both(spark, query, sql, sf_dir):
    rows = query(spark, sf_dir)
    names = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in rows.collect()), key=repr)
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in found.fetchall()), key=repr)
    assert sorted(columns) == names
    return got, want
