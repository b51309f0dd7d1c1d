"""Rows of a query and of its SQL twin, as sorted texts."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def shown(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9)) if v != int(v) else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def duck_rows(sql, folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    c.execute(sql)
    names = [d[0] for d in c.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(shown(r[i]) for i in order) for r in c.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(shown(v) for v in r) for r in df.select(names).collect())
