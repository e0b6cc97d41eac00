"""The queries of the newer operators against their SQL."""

import duckdb
import pytest

from talentloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_repeats", "op12_vector_codes", "op13_ranked_search"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
