"""Links: kinds, hosts, copies within a page, and skewed counts."""

from collections import Counter

from pyspark.sql import functions as F

from helpers import apply, pages, tuples
from pagesieve.functions import link_host, link_kind
from pagesieve.operators import link_counts, page_links

KINDS = {
    "https://Shop.Example/a": ("https", "shop.example"),
    "HTTP://shop.example:8080/a": ("http", "shop.example"),
    "https://user:pw@shop.example/a@b": ("https", "shop.example"),
    "https://shop.example?q=a/b@c": ("https", "shop.example"),
    "https://shop.example/a?q=%zz": ("https", "shop.example"),
    "https://maps.example/search/דרך+ארוכה": ("https", "maps.example"),
    "https://[2001:db8::1]:80/a": ("https", "[2001:db8::1]"),
    "https:///a": ("https", None),
    "//cdn.example/a": ("scheme-relative", "cdn.example"),
    "tel:+10000": ("tel", None),
    "mailto:a@shop.example": ("mailto", None),
    "#top": ("fragment", None),
    "/a:b": ("relative", None),
    "a/b?x=https://no.example/": ("relative", None),
    "?q=1": ("relative", None),
    "": ("relative", None),
    None: (None, None),
}

PAGE = """<a href="https://shop.example/a?text=%D7%94%2C+x&amp;n=1">order</a>
    <a class="call" href='tel:+10000'>call</a> <a href=#top>top</a>
    <a href="https://maps.example/דרך+ארוכה">map</a> <a href="/bad/%zz">bad</a>
    <a href="https://shop.example/a?text=%D7%94%2C+x&amp;n=1">order again</a>
    <link href="https://fonts.example/f.css"> <img src="p.jpg" alt="a > b"><img src="p.jpg">"""


def test_kind_and_host(spark):
    assert apply(spark, link_kind, list(KINDS)) == [k for k, _ in KINDS.values()]
    assert apply(spark, link_host, list(KINDS)) == [h for _, h in KINDS.values()]


def test_page_links(spark):
    df = pages(spark, PAGE, "<p>no link</p>", None)
    assert tuples(page_links(df)) == sorted(
        [
            (0, "https://shop.example/a?text=%D7%94%2C+x&n=1", "https", "shop.example", 2),
            (0, "tel:+10000", "tel", None, 1),
            (0, "#top", "fragment", None, 1),
            (0, "https://maps.example/דרך+ארוכה", "https", "maps.example", 1),
            (0, "/bad/%zz", "relative", None, 1),
        ],
        key=repr,
    )
    assert tuples(page_links(df, "img", "src")) == [(0, "p.jpg", "relative", None, 2)]


def test_link_counts(spark):
    df = pages(spark, PAGE, PAGE, '<a href="TEL:1">x</a>')
    assert tuples(link_counts(df, "kind")) == sorted(
        [("https", 6, 2), ("tel", 3, 3), ("fragment", 2, 2), ("relative", 2, 2)], key=repr
    )
    assert tuples(link_counts(df, "host")) == sorted(
        [("shop.example", 4, 2), ("maps.example", 2, 2), (None, 7, 3)], key=repr
    )


def test_a_page_seen_twice_counts_twice(spark):
    df = pages(spark, PAGE)
    both = df.union(df)
    assert Counter(tuples(page_links(both))) == Counter(tuples(page_links(df)) * 2)
    assert ("https", 6, 2) in tuples(link_counts(both, "kind"))


def test_hot_host_and_long_page(spark):
    """One host holds a third of all links, one page another third."""
    hot = F.lit('<a href="https://hot.example/">x</a>')
    one = F.concat(F.lit('<a href="https://h'), F.col("id"), F.lit('.example/">x</a>'))
    df = spark.range(3000).select(
        F.col("id").alias("page_id"),
        F.lit("u").alias("url"),
        F.when(F.col("id") == 0, F.repeat(F.lit('<a href="/same">x</a>'), F.lit(3000)))
        .otherwise(F.concat(hot, one)).alias("html"),
    )
    counts = {host: (links, n) for host, links, n in tuples(link_counts(df, "host"))}
    assert len(counts) == 3001
    assert counts["hot.example"] == (2999, 2999)
    assert counts["h17.example"] == (1, 1)
    assert counts[None] == (3000, 1)
