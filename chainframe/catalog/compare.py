"""Side-by-side check of registered queries against their SQL."""

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "null" if v != v else repr(round(v, 9) + 0.0)
    if v is None or v is pd.NA or v is pd.NaT:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in records)


def differences(spark_df, con, sql: str, show: int = 3):
    """None when equal, else a short description."""
    left_cols = spark_df.columns
    left = rows(left_cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    right_cols = [d[0] for d in cur.description]
    right = rows(right_cols, cur.fetchall())
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(left_cols)} vs {sorted(right_cols)}"
    if left == right:
        return None
    ls, rs = set(left), set(right)
    return (
        f"{len(left)} vs {len(right)} rows; only spark {sorted(ls - rs)[:show]}; "
        f"only sql {sorted(rs - ls)[:show]}"
    )
