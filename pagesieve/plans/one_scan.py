"""All general page outputs from one scan of the raw pages.

The markup is by far the widest column and reading it is most of the cost, so a
large crawl should be read once. ``page_facts`` puts every output of a page into
one row, ``store_facts`` writes that table, and the other functions read only the
columns they need from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions import (
    language,
    named_meta,
    start_tags,
    targets,
    title,
    visible_text,
)
from pagesieve.operators.links import count_links, explode_links


def page_facts(pages: DataFrame) -> DataFrame:
    """``page_id, lang, title, meta, hrefs, text``, one row per page, no shuffle."""
    html = pages.html
    tags = F.col("tags")
    return pages.select("page_id", html, start_tags(html, "a", "meta").alias("tags")).select(
        "page_id",
        language(html).alias("lang"),
        title(html).alias("title"),
        named_meta(tags).alias("meta"),
        targets(tags).alias("hrefs"),
        visible_text(html).alias("text"),
    )


def store_facts(facts: DataFrame, path: str | None = None) -> DataFrame:
    """Write the facts to a new folder and return the table read back from it.

    Without ``path`` the table goes under the shared folder that the session names
    in ``spark.checkpoint.dir``. Later jobs start from the written table, so a lost
    executor costs them nothing that came before it.
    """
    spark = facts.sparkSession
    if path is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            raise ValueError("give a path, or set spark.checkpoint.dir to a shared folder")
        path = f"{shared}/page_facts-{uuid.uuid4()}"
    facts.write.mode("errorifexists").parquet(path)
    return spark.read.schema(facts.schema).parquet(path)


def facts_metadata(facts: DataFrame) -> DataFrame:
    return facts.select("page_id", "lang", "title")


def facts_named_meta(facts: DataFrame) -> DataFrame:
    return facts.select("page_id", F.inline("meta"))


def facts_links(facts: DataFrame) -> DataFrame:
    return explode_links(facts, F.col("hrefs"))


def facts_link_counts(facts: DataFrame, by: str) -> DataFrame:
    return count_links(facts, F.col("hrefs"), by)


def facts_text(facts: DataFrame) -> DataFrame:
    return facts.select("page_id", "text")
