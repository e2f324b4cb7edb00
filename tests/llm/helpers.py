"""DuckDB side of the comparisons."""

import duckdb


def oracle_rows(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(repr({k: v for k, v in sorted(zip(names, row))}) for row in got.fetchall())


def spark_rows(df):
    return sorted(repr({k: v for k, v in sorted(r.asDict().items())}) for r in df.collect())
