"""Compare a query with its SQL twin in DuckDB."""

import math
import os

import duckdb

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return float(f"{x:.10g}")
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, con, sql):
    """What differs, as text; empty if nothing does."""
    res = con.execute(sql)
    columns, types = [d[0] for d in res.description], {d[0]: str(d[1]) for d in res.description}
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    wrong = {c: (k, types[c]) for c, k in df.dtypes if KINDS.get(k, k) != types[c] and k in KINDS}
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, res.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"columns {sorted(columns)}: {x} and {y}; types {wrong}"
    return f"types {wrong}" if wrong else ""
