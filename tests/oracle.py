"""Run a query and its SQL and compare rows as the driver does: by name-sorted columns, in no order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(x + 0.0) if x else "0.0"
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return sorted((str(k), plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if type(x).__name__ == "Decimal":
        return repr(float(x))
    return str(x)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def compare(name, df, con, sql):
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names, (name, sorted(rel.columns), names)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == types, name
    at = [rel.columns.index(c) for c in names]
    want = sorted([plain(r[i]) for i in at] for r in rel.fetchall())
    assert len(got) == len(want), (name, len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (name, len(bad), names, bad[:3])
    return len(got)
