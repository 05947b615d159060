import duckdb
import pytest

from loomline.llm import queries_dedup, registry

from .helpers import rows, table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "clicks"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_near_dedup_sql_on_odd_rows(spark):
    from loomline.llm import dedup

    docs = table(spark, rows())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = dedup.near_duplicates(docs, percent=85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = con.sql(queries_dedup.ORACLE_SQL).fetchall()
    # without words a document is its own; SQL calls it so by its id
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
