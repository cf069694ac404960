import os

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows_of(df):
    """Rows as sorted tuples, columns by name."""
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES.split():
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)
