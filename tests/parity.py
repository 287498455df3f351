"""Comparison of a query with its oracle SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(normal, value)) + "]"
    return repr(value)


def rows_of_query(df):
    names = sorted(df.columns)
    return names, sorted(tuple(normal(r[c]) for c in names) for r in df.collect())


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    given = [c[0] for c in got.description]
    names = sorted(given)
    return names, sorted(tuple(normal(r[given.index(c)]) for c in names) for r in got.fetchall())
