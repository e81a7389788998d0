"""Runs a query and its SQL over the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    plain = frame[cols].astype(object).where(frame[cols].notna(), None)
    fix = lambda v: None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else getattr(v, "item", lambda: v)()
    return cols, sorted((tuple(fix(v) for v in t) for t in plain.itertuples(index=False)), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got_names, got = rows(query(spark, sf_dir).toPandas())
    names, expected = rows(con.execute(sql).df())
    assert got_names == names
    assert len(got) == len(expected)
    assert [(g, e) for g, e in zip(got, expected) if g != e][:3] == []
