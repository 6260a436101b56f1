"""Every query with SQL against it, on whole tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from pagesieve.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in contract.queries() if n.startswith("op") or n == "pipeline"]
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    result = QUERIES[name](spark, SF)
    with duckdb.connect() as db:
        for table in ("documents", "embeddings", "pages", "labels", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        found = db.execute(ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        expected = Counter(found.fetchall())
    assert sorted(columns) == sorted(result.columns)
    assert Counter(tuple(r) for r in result.select(*columns).collect()) == expected
