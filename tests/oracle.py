"""Compare a query with its SQL over one folder of tables, as multisets of rows."""

from collections import Counter

import duckdb

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or x != x:
        return None
    return repr(x) if isinstance(x, float) else str(x)


def compare(spark, query, sql, folder=FOLDER, views=None):
    con = duckdb.connect()
    for t, path in (views or {t: f"{folder}/{t}.parquet" for t in TABLES}).items():
        con.sql(f"create view {t} as select * from '{path}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    rows = con.sql(sql)
    at = [rows.columns.index(c) for c in columns]
    assert sorted(rows.columns) == columns
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rows.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
