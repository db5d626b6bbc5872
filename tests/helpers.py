import datetime as dt

import duckdb


def day(text):
    return dt.date.fromisoformat(text)


def month(i, start=2000):
    return dt.date(start + i // 12, i % 12 + 1, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def column(df, col, order="date"):
    return [r[0] for r in df.orderBy(order).select(col).collect()]


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()
