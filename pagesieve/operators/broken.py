"""Links inside a site that lead to no page of the table.

Every link is resolved against the URL of its page and compared, without its fragment,
with the URLs of all pages by an anti join on that string. A target that more than a
thousandth of all links have would be a hot key of the join. There are fewer than a
thousand of these, so they are looked up once each and joined by a broadcast of that
bound; all others go through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions import link_host, resolve, start_tags, targets, value_counts

#: A target with more than this share of all links is hot.
SHARE = 1000


def internal_links(pages: DataFrame) -> DataFrame:
    """``page_id, href, target, n``: links whose resolved target has the host of their page."""
    found = targets(start_tags(pages.html, "a"), "a", "href")
    links = pages.select("page_id", "url", F.inline(value_counts(found)).alias("href", "n"))
    links = links.withColumn("target", resolve(F.col("url"), F.col("href")))
    same = link_host(F.col("target")) == link_host(F.col("url"))
    return links.filter(same).select("page_id", "href", "target", "n")


def page_addresses(pages: DataFrame) -> DataFrame:
    """``target``: the distinct URLs of pages, as links are resolved to them."""
    address = resolve(F.col("url"), F.lit(""))
    return pages.select(address.alias("target")).filter("target IS NOT NULL").distinct()


def broken_links(pages: DataFrame) -> DataFrame:
    """``page_id, href, target, n`` of internal links whose target is no page.

    A page without a URL is nobody's target and has no internal links. A page that is in
    the table twice has its links twice.
    """
    links, known = internal_links(pages), page_addresses(pages)
    counts = links.groupBy("target").agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = [r.target for r in counts.filter(F.col("rows") * SHARE > total).select("target").collect()]
    names = pages.sparkSession.createDataFrame([(x,) for x in hot], "target string")
    hot_broken = names.join(known, "target", "left_anti")
    usual = links.join(F.broadcast(names), "target", "left_anti").join(known, "target", "left_anti")
    often = links.join(F.broadcast(hot_broken), "target", "left_semi")
    columns = ("page_id", "href", "target", "n")
    return usual.select(*columns).union(often.select(*columns))


def broken_targets(pages: DataFrame) -> DataFrame:
    """``target, n_links, n_pages`` of what broken links lead to, summed before the shuffle."""
    links = internal_links(pages).groupBy("target").agg(
        F.sum("n").alias("n_links"), F.count("*").alias("n_pages")
    )
    return links.join(page_addresses(pages), "target", "left_anti")
