"""Runs a query and its SQL side by side."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "normalize"):
        return round(float(x), 6)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, query, sql):
    df = query(spark, sf)
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns), (df.columns, found.columns)
    spark_types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}
    kinds = {c: str(t) for c, t in zip(found.columns, found.types)}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if spark_types.get(t) and spark_types[t] != kinds[c]}
    got, want = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert got == want, (len(got), len(want), [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
    assert not odd, odd
    return len(got)
