"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables; those without SQL give rows."""

import os

import duckdb
import pytest

from intervale.plans import catalogue

D = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].astype(float) if df[c].dtype.kind in "iufb" else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, name):
    got = catalogue.queries()[name](spark, D).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = values(got), values(want)
    assert len(a) == len(b) and ((a - b).abs().max().max() < 1e-5 if all(x.kind == "f" for x in a.dtypes) else a.equals(b))
