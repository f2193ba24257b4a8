"""Every query of the training-data operators that SQL can express, against its DuckDB oracle."""

import duckdb
import pandas as pd
import pytest

from tessella.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(df):
    df = df[sorted(df.columns)]
    text = df.astype(object).map(lambda v: "NULL" if v is None or v is pd.NA or v != v else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    wanted = duck.execute(queries.ORACLES[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(wanted))
