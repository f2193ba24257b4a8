"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__  # noqa: F401
from tessella.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    def text(v):
        return "NULL" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    for c in df:
        df[c] = df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    wanted = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    numeric = [c for c in got if pd.api.types.is_numeric_dtype(got[c]) or pd.api.types.is_numeric_dtype(wanted[c])]
    for c in numeric:
        got[c], wanted[c] = got[c].astype("float64"), wanted[c].astype("float64")
    pd.testing.assert_frame_equal(plain(got), plain(wanted))


def test_entry_has_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "chunk_id", "first_line", "last_line", "n_lines", "num_tokens", "is_over_budget"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
