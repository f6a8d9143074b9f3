"""Runs a query and its SQL on one set of tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


def rows(pdf) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False, name=None))
