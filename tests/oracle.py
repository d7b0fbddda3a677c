"""A query and its SQL, compared as bags of rows."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def told(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(told, v)) + "]"
    return str(v)


def sql_rows(sql, sf_dir=SF):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rows = c.execute(sql).fetchall()
    return [x[0] for x in c.description], rows


def agree(df, sql, sf_dir=SF):
    names, rows = sql_rows(sql, sf_dir)
    order = sorted(df.columns)
    assert sorted(names) == order
    got = sorted("|".join(told(r[c]) for c in order) for r in df.collect())
    want = sorted("|".join(told(r[names.index(c)]) for c in order) for r in rows)
    assert got == want
