"""Side-by-side runs of registered queries in Spark and DuckDB."""

import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    return tuple(map(plain, v)) if isinstance(v, list) else v


def both(spark, sf_dir, query, sql):
    """Sorted rows of both sides, columns by name."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in cursor.fetchall())
    return (columns, ours), (sorted(names), theirs)
