"""A query of Spark against its SQL in DuckDB, as bags of rows."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        return repr(x.item() if hasattr(x, "item") else x)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(spark, con, query, sql, sf_dir=DATA):
    df = query(spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = bag([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    missing, extra = [r for r in want[1] if r not in set(got[1])][:3], [r for r in got[1] if r not in set(want[1])][:3]
    assert got[1] == want[1], (len(got[1]), len(want[1]), missing, extra)
