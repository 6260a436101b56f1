"""Every registered query against its SQL, on whole tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from helpers import tuples
from pagesieve import operators as op
from pagesieve.sources import read_pages
from rendered import HOURS_PATTERN, PRICE_PATTERN, rendered_pages

SF_DIRS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert contract.library_queries().keys() == contract.library_sql().keys()


@pytest.mark.parametrize("sf_dir", SF_DIRS)
@pytest.mark.parametrize("name", sorted(contract.library_queries()))
def test_query_matches_sql(spark, name, sf_dir):
    result = contract.library_queries()[name](spark, sf_dir)
    with duckdb.connect() as db:
        for table in ("pages", "part", "events", "orders"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        expected = db.execute(contract.library_sql()[name])
        columns = [c[0] for c in expected.description]
        rows = expected.fetchall()
    assert sorted(result.columns) == sorted(columns)
    got = _rows(result.columns, [tuple(r) for r in result.collect()])
    assert got == _rows(columns, rows)
    assert rows


def test_entry(spark):
    assert contract.entry(spark).columns == ["page_id", "href", "kind", "host", "n"]


def test_rows_of_a_mixed_crawl_come_from_the_pages_that_have_them(spark):
    crawl = read_pages(spark, f"{SF_DIRS[0]}/pages.parquet")
    shops = rendered_pages(spark.read.parquet(f"{SF_DIRS[0]}/part.parquet"))
    for job, pattern in ((op.price_rows, PRICE_PATTERN), (op.opening_hours, HOURS_PATTERN)):
        assert job(crawl, pattern).isEmpty()
        assert tuples(job(crawl.union(shops), pattern)) == tuples(job(shops, pattern))


def test_rendered_pages_are_many_tasks_where_the_table_is_one_file(spark, tmp_path):
    """A table is read as one task if its file is small, however many pages it makes."""
    columns = ["id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id % 50 AS int) AS p_size", "id / 7 AS p_retailprice"]
    spark.range(9000).selectExpr(*columns).coalesce(1).write.parquet(str(tmp_path / "part"))
    parts = spark.read.parquet(str(tmp_path / "part"))
    pages = rendered_pages(parts)
    assert parts.rdd.getNumPartitions() == 1 and pages.rdd.getNumPartitions() == 8
    assert max(map(len, pages.select("page_id").rdd.glom().collect())) < 2000
    assert pages.select("page_id").distinct().count() == pages.count() == 9000
    assert rendered_pages(parts.limit(0)).isEmpty()
