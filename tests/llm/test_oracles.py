"""Operators that SQL can express against DuckDB."""

import duckdb
import pandas as pd
import pytest

from loomwright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, sf_dir).toPandas()
    order = sorted(want.columns)
    assert order == sorted(got.columns)
    same = lambda df: df[order].astype(object).where(df[order].notna(), None).sort_values(order, key=lambda c: c.astype(str)).values.tolist()
    a, b = same(want), same(got)
    assert len(a) == len(b) and all([str(x).removesuffix(".0") for x in r] == [str(x).removesuffix(".0") for x in s] for r, s in zip(a, b))
