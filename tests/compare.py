"""Rows of a Spark query against rows of DuckDB, whatever their order."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(x):
    if hasattr(x, "asDict"):
        return [plain(v) for v in x]
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return None if math.isnan(x) else int(x) if x == int(x) else round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in values)


def oracle(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall())


def same(df, folder: str, sql: str) -> None:
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), oracle(folder, sql)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
