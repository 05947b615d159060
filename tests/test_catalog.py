import duckdb
import pandas as pd
import pytest

import __spark_entry__
from loomline.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df, columns):
    plain = lambda v: v if isinstance(v, list) else None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows_of(got, columns) == rows_of(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan("knn_topk") and "Exchange" not in plan("knn_topk")
    for name in ("manifest_diff", "budget_pack", "classify_blocks", "engineer_context", "trim_budget", "request_stats", "log_counts", "inject_context"):
        assert "Python" not in plan(name) and "Pandas" not in plan(name), name
