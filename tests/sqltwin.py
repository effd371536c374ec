"""Compares a query with its SQL twin on the same tables."""

import glob
import math
import os

import duckdb
import pandas as pd


def rows(df):
    names = sorted(df.columns)
    out = [tuple(None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else str(x) for x in r) for r in df[names].itertuples(index=False)]
    return names, sorted(out, key=str)


def check(spark, name, sf_dir, queries, oracles):
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    mine, theirs = rows(queries[name](spark, sf_dir).toPandas()), rows(db.execute(oracles[name]).df())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1], strict=True):
        assert all(x == y or str(x) == str(y) or (isinstance(x, float) and abs(float(x) - float(y)) < 1e-6) for x, y in zip(a, b, strict=True)), (a, b)
