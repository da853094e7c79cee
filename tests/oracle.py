"""Holds a query against the SQL that another engine answers it with."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.01"


def engine(sf=SF):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, function, sql, sf=SF):
    df = function(spark, sf)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    other = engine(sf).sql(sql)
    theirs = rows(other.columns, other.fetchall())
    assert ours[0] == theirs[0], (name, ours[0], theirs[0])
    assert len(ours[1]) == len(theirs[1]), (name, len(ours[1]), len(theirs[1]))
    odd = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if a != b]
    assert not odd, (name, len(odd), odd[:3])
    return len(ours[1])
