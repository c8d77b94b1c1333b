"""Every registered core query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from framewright.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return repr([plain(y) for y in x])
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (float, np.floating)) and not isinstance(x, bool):
        return repr(int(x) if float(x).is_integer() else round(float(x), 6))
    return repr(x.item() if isinstance(x, np.generic) else x)


def rows(pdf):
    return sorted(tuple(plain(x) for x in r) for r in pdf.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(ORACLES[name]).df()
    assert sorted(want.columns) == cols
    assert rows(got.select(*cols).toPandas()) == rows(want[cols])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_read_few_columns_and_push_filters(spark):
    plan = QUERIES["sidecar_anti"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
    plan = QUERIES["profile_report"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThanOrEqual(c_acctbal,0.0)" in plan


def test_uses_no_python_on_relational_paths(spark):
    for name in set(ORACLES):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
