"""Comparing a Spark result with DuckDB SQL over the same tables."""

import duckdb


def compare(spark, run, sql, sf_dir):
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    want = con.sql(sql)
    columns = list(want.columns)
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[n]) for n in names) for r in df.collect()) == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())
