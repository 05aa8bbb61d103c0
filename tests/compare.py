"""Query results and SQL results as sorted rows of text."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(map(shown, v.values())) + "}"
    return "~" if v is None else str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return columns, sorted(tuple(shown(r[c]) for c in columns) for r in rows)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(shown(r[k]) for k in order) for r in result.fetchall())
