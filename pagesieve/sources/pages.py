"""The page table: one row per page, ``(page_id, url, html)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The page table at ``path``.

    A Parquet row group cannot be split. Where that leaves cores idle, ``partitions``
    deals the rows out anew; without it the scan's own partitions stay.
    """
    pages = spark.read.schema(PAGE_SCHEMA).parquet(path)
    return pages if partitions is None else pages.repartition(partitions)
