"""Compare a Spark result with DuckDB's answer to the SQL."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, decimal.Decimal):
        return str(x.normalize()) if x else "0"
    return str(x)


def rows(table):
    names = sorted(table.column_names)
    columns = [[cell(x) for x in table.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns, strict=True))


def same(con, df, sql):
    got = rows(df.toArrow())
    want = rows(con.execute(sql).to_arrow_table())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    return len(got[1])
