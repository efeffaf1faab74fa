"""Compares a query with its SQL on the same Parquet tables."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=SF):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            db.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def same(spark_frame, db, sql):
    names = sorted(spark_frame.columns)
    mine = sorted("|".join(plain(row[n]) for n in names) for row in spark_frame.collect())
    result = db.execute(sql)
    theirs_names = [d[0] for d in result.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(n) for n in names]
    theirs = sorted("|".join(plain(row[i]) for i in at) for row in result.fetchall())
    assert mine == theirs
