"""Links of each page, and how many links and pages each kind or host has.

Copies within a page are counted inside the page's row. The detail therefore
needs no shuffle, and a page reaches the grouped counts as one row per key, which
Spark sums up on the map side: a hot kind or host arrives at its reducer as one
row per task, whatever share of the links it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions import attribute, link_host, link_kind, start_tags, targets, value_counts

_KEYS = {"kind": link_kind, "host": link_host}


def explode_links(pages: DataFrame, found: Column) -> DataFrame:
    return pages.select(
        "page_id", F.inline(value_counts(found)).alias("href", "n")
    ).select(
        "page_id",
        "href",
        link_kind(F.col("href")).alias("kind"),
        link_host(F.col("href")).alias("host"),
        "n",
    )


def count_links(pages: DataFrame, found: Column, by: str) -> DataFrame:
    keys = F.transform(found, _KEYS[by])
    return (
        pages.select(F.inline(value_counts(keys)).alias(by, "n"))
        .groupBy(by)
        .agg(F.sum("n").alias("n_links"), F.count("*").alias("n_pages"))
    )


def page_links(pages: DataFrame, tag: str = "a", attr: str = "href") -> DataFrame:
    """``page_id, href, kind, host, n``, one row per page and distinct target."""
    return explode_links(pages, targets(start_tags(pages.html, tag), tag, attr))


def page_images(pages: DataFrame) -> DataFrame:
    """``page_id, href, kind, host, n, alt``, one row per page and distinct image."""
    tags = start_tags(pages.html, "img")
    images = F.transform(
        tags,
        lambda t: F.struct(
            attribute(t, "src", "img").alias("href"), attribute(t, "alt", "img").alias("alt")
        ),
    )
    found = F.filter(images, lambda x: x["href"].isNotNull())
    href = F.col("image.href")
    return pages.select("page_id", F.inline(value_counts(found)).alias("image", "n")).select(
        "page_id",
        href.alias("href"),
        link_kind(href).alias("kind"),
        link_host(href).alias("host"),
        "n",
        F.col("image.alt").alias("alt"),
    )


def link_counts(
    pages: DataFrame, by: str, tag: str = "a", attr: str = "href"
) -> DataFrame:
    """``kind`` or ``host``, with ``n_links, n_pages``."""
    return count_links(pages, targets(start_tags(pages.html, tag), tag, attr), by)
