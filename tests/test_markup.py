"""Markup functions on hand-written cases, random pages and hostile input."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from helpers import apply, pages
from pagesieve.functions import (
    attribute,
    language,
    named_meta,
    start_tags,
    targets,
    title,
    value_counts,
    visible_text,
)


def hrefs(html):
    return targets(start_tags(html, "a"))


def test_attribute(spark):
    cases = {
        'a href="x"': "x",
        "a href='x y'": "x y",
        "a href=x>": "x",
        "a/href=x/y>": "x/y",
        'A HREF = "x"': "x",
        'a class="c"href="x"': "x",
        'a data-href="no" href="x"': "x",
        'a title="see href=no" href="x"': "x",
        'a title="a > b" href="x">': "x",
        'a href="first" href="second"': "first",
        'a download href="x"': "x",
        'a = href="x"': "x",
        'a href="?a=1&amp;b=2"': "?a=1&b=2",
        'a href=" \n x "': "x",
        'a href=""': "",
        "a href": None,
        'a name="q"': None,
        'a xhref="no"': None,
        'a xml:href="no"': None,
        None: None,
    }
    assert apply(spark, lambda t: attribute(t, "href"), list(cases)) == list(cases.values())


def test_language_and_title(spark):
    cases = {
        '<html lang="he"><title>t</title>': ("he", "t"),
        '<!doctype html><!-- <html lang="no"> --><HTML dir=rtl LANG=en><TITLE lang="x">\n A &amp; B\t</TITLE>':
            ("en", "A & B"),
        '<script>"<html lang=\'no\'>"; "<title>no</title>"</script><html><title>a < b</title>':
            (None, "a < b"),
        '<html xml:lang="no" data-lang="no"><title></title>': (None, ""),
        "<html lang='he'><title>never closed": ("he", "never closed"),
        "<htmlx lang='no'><titles>no</titles>": (None, None),
        """<p title="<title>no</title><html lang='no'><!--"><html lang=x><title>t""": ("x", "t"),
        "plain": (None, None),
        "": (None, None),
        None: (None, None),
    }
    assert apply(spark, language, list(cases)) == [v[0] for v in cases.values()]
    assert apply(spark, title, list(cases)) == [v[1] for v in cases.values()]


def test_named_meta(spark):
    html = """<meta charset="utf-8"><meta name="viewport" content="width=1, x=2">
        <META property='og:title' content='it&apos;s "q" &gt; 1' />
        <meta content="9" property="og:n"><meta name="empty">
        <!-- <meta name="no" content="no"> --><script>'<meta name="no">'</script>"""
    assert apply(spark, lambda h: named_meta(start_tags(h, "meta", "a")), [html]) == [
        [("viewport", "width=1, x=2"), ("og:title", "it's \"q\" > 1"), ("og:n", "9"),
         ("empty", None)]
    ]


def test_visible_text(spark):
    cases = {
        "<h1>a<span>b</span></h1>": "a b",
        "<title>no</title><p>a<br>b<p>c": "a b c",
        "a<script>no</script>b<style>no</style>c<!-- no -->d": "a b c d",
        "a<script>var t='</p>'; <!-- </script>b<!-- <script> -->c": "a b c",
        "a<!-->b<!--->c<!-- no --!>d": "a b c d",
        '<p title="a > b">x</p><p title=\'<b>\'>y': "x y",
        "1 < 2 and <3 &lt;b&gt;": "1 < 2 and <3 <b>",
        "a &nbsp; \n\t b": "a b",
        "a<script>never closed": "a",
        """<p title="<!-- ">b<p title='<script>'>c""": "b c",
        "a<!-- never closed": "a",
        "a<b class=": "a",
        "<p>a</p": "a",
        "<scripts>a</scripts>": "a",
        "": "",
        None: None,
    }
    assert apply(spark, visible_text, list(cases)) == list(cases.values())


def test_value_counts(spark):
    df = spark.sql("""
        SELECT * FROM VALUES (0, array('b', 'a', 'b', 'b', 'c', 'a')), (1, array('x')),
            (2, array()), (3, array('b', NULL, NULL)), (4, NULL) AS t(i, v)
    """)
    got = {r.i: r.c and [tuple(x) for x in r.c] for r in df.select("i", value_counts(F.col("v")).alias("c")).collect()}
    assert got == {
        0: [("a", 2), ("b", 3), ("c", 1)], 1: [("x", 1)], 2: [], 3: [("b", 1), (None, 2)], 4: None,
    }


class _Links(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.links, self.text = [], []
        self.hidden = 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.text.append(" ")
        self.hidden += tag in ("script", "style", "title")
        if tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            if href is not None:
                self.links.append(" ".join(href.split()))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.text.append(" ")
        self.hidden -= tag in ("script", "style", "title") and self.hidden > 0

    def handle_comment(self, data):
        self.text.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def _random_page(rng):
    pieces = [
        "<p>", "</p>", "<b>", "<br/>", " ", "\n", "word", "שלום", "1 &lt; 2", "&amp;amp;", "&copy;",
        '<a href="/x?a=1&amp;b=2">', "<a href='#f'>", "<a href=plain>", "</a>", "<A HREF=\"/x\">",
        '<a title="href=/no" data-href="/no" href="/real">', "<a name='n'>", "<img src='i.png'>",
        "<!-- <a href='/no'>no</a> -->", "<script>var a='<a href=\"/no\">';</script>",
        "<style>a > b {}</style>", "<title>t <b> t</title>", '<p title="a > b">',
        "<script>if (a < b) {} <!-- x</script>", '<p title="<!-- x">',
        """<img alt='<a href="/no">' src="<script>">""", '<p data-x="<style>">',
    ]
    return "<body>" + "".join(rng.choices(pieces, k=rng.randint(0, 60))) + "</body>"


def test_links_and_text_against_a_parser(spark):
    rng = random.Random(7)
    # Python's parser reads tags inside a title; ours, like a browser, does not.
    html = [_random_page(rng).replace("t <b> t", "t t") for _ in range(400)]
    parsed = [_Links(h) for h in html]
    assert apply(spark, hrefs, html) == [p.links for p in parsed]
    assert apply(spark, visible_text, html) == [" ".join("".join(p.text).split()) for p in parsed]


def test_driver_pages_against_a_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    html = [r.html for r in rows]
    # Python's parser also decodes "&amp" without ";", and drops a tag cut off at the end.
    whole = [h for h in html if h.endswith("</html>")]
    assert len(whole) > 200
    parsed = [_Links(h) for h in whole]
    assert apply(spark, hrefs, whole) == [p.links for p in parsed]
    assert apply(spark, visible_text, whole) == [
        " ".join("".join(p.text).split()) for p in parsed
    ]


N = 200_000
HOSTILE = {
    "one tag, many attributes": "<a " + "x=1 " * N + ">",
    "one tag, many quoted attributes": "<a " + 'x="1" ' * N + "href='y'>",
    "open tags": "<a " * N,
    "open tags with open quotes": "<a href=\"" * N,
    "open tags with mixed quotes": "<a x=\"<a y='" * N,
    "open comments": "<!--" * N,
    "comment dashes": "<!--" + "-" * N,
    "open scripts": "<script>" * N,
    "open titles": "<title>" * N,
    "less-than signs": "< " * N,
    "equals signs": "<a " + "=" * N,
    "references": "&amp;" * N,
    "bare ampersands": "&" * N,
    "white space": " \n" * N,
    "html words": "<html" * N,
    "slashes": "<a" + "/" * N,
    "open class attributes": "<div class=\"" * N,
    "many links": '<a href="/same">' * N,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_markup_takes_linear_time(spark, name):
    df = pages(spark, HOSTILE[name])
    started = time.time()
    (row,) = df.select(
        language(df.html), title(df.html), named_meta(start_tags(df.html, "meta")),
        value_counts(hrefs(df.html)).alias("links"), visible_text(df.html),
    ).collect()
    assert time.time() - started < 30
    if name == "many links":
        assert [tuple(x) for x in row.links] == [("/same", N)]
    if name == "one tag, many quoted attributes":
        assert [tuple(x) for x in row.links] == [("y", 1)]
