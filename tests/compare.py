"""Hold a DataFrame against DuckDB's answer: same columns, same rows, in any order."""

import os
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{source}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or v.__class__.__name__ == "Decimal" else str(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in values)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    result = connect(sf_dir).execute(sql)
    wanted = rows([d[0] for d in result.description], result.fetchall())
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]
