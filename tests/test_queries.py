"""Every named query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexiscape.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return repr(list(v))
        if v is None or v is pd.NaT or isinstance(v, (float, np.floating)) and np.isnan(v):
            return "null"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 5) + 0.0)
        return str(v)

    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, duck, name):
    assert canonical(QUERIES[name](spark, small).toPandas()) == canonical(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
