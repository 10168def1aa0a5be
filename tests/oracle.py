"""Holds registered queries against their SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def differences(spark, con, name, query, sql, sf_dir):
    rel = con.execute(sql)
    names = sorted(c[0] for c in rel.description)
    order = [c[0] for c in rel.description]
    want = sorted(str([dict(zip(order, r))[n] for n in names]) for r in rel.fetchall())
    df = query(spark, sf_dir)
    if sorted(df.columns) != names:
        return f"{name}: columns {sorted(df.columns)} and {names}"
    got = sorted(str([r[n] for n in names]) for r in df.collect())
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"{name}: {len(got)} and {len(want)} rows; {odd}"
    return None
