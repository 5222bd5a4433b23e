"""Comparison of a query's rows with DuckDB's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
