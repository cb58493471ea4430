import decimal
import hashlib

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    return repr(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(_norm(r[c]) for c in cols) for r in df.select(*cols).collect())


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted("|".join(_norm(r[i]) for i in idx) for r in cur.fetchall())


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
