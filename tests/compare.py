"""Compare a query with its SQL in DuckDB: same columns, same rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio"):
        return repr(round(float(x) + 0.0, 7))
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in data)


def difference(spark, query, sql, sf_dir, con=None):
    """None if both agree, else a short text."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    cursor = (con or connect(sf_dir)).execute(sql)
    theirs = rows([c[0] for c in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return f"{len(ours[1])} and {len(theirs[1])} rows; only here {sorted(a - b)[:2]}, only there {sorted(b - a)[:2]}"
    return None
