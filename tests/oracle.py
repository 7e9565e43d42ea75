"""Rows of a query against those of its SQL in another engine."""

import os

import duckdb


def same(spark, query, sql, sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = query(spark, sf).toPandas(), c.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    table = lambda df: sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=repr)
    a, b = table(got), table(want)
    assert len(a) == len(b) and a == b
