"""Pages that Spark renders from the ``part`` table, one page per part.

A crawl may hold no price list, opening hours, named meta tag or outside link at all.
These pages hold every one of them, in several shapes that columns of ``part`` choose,
with the markup traps of real pages. What the jobs must read back follows from ``part``
alone. They belong to the checks, not to the package, and grow with the table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.operators.rows import class_rows

PRICE_PATTERN = class_rows(("div", "price-row"), ("span", "item"), ("span", "amount"))
HOURS_PATTERN = class_rows(("div", "open-row"), ("span", "day"), ("span", "time"))

# A task renders so many pages at least, as long as there are tasks for more.
_TASK_ROWS = 1000

# "{x}" stands for a column of the rendering below.
_TEMPLATE = """<!DOCTYPE html>
<!-- <html lang="xx"><a href="/hidden">hidden</a> -->
<html dir="rtl"{lang}><head><meta charset="utf-8">
<META name="description" content="{brand} &amp; {type}">
<meta property='og:title' content='{name} > all'>
<meta content="{price}" property="product:price" />
<meta name=description content=again{size}>
{title}
<style>a > b { color: red }</style>
<script>var t = "</p><a href='/script'>"; <!-- if (1 < 2) track({key});</script>
</head><body title="a > b">
<h1>{name}<span>{brand}</span></h1>
<a class="order" href="https://{host}/p/{key}?a=1&amp;b=%zz">order</a>
<A title='see href=/no' HREF='tel:+100{key}'>call</A>
<textarea><a href="/typed">typed</a></textarea><template><img src="no.jpg"></template>
<a href="#prices">prices</a> <a data-href="/no" href=/size/{size}>size</a> <a name="top"></a>
<a href="//maps.example.net/חיפוש+{key}" target="_blank">map</a>
<img src="p{key}.jpg" alt="a > {name}"><IMG SRC=plain.png>
<!-- <div class="price-row"><span class="item">old</span><span class="amount">₪1</span></div> -->
{rows}
<a class="order" href="https://{host}/p/{key}?a=1&amp;b=%zz">order</a>
<footer>&copy; {name} 1 < 2 &quot;{brand}&quot; &amp;lt;</footer>"""

_ROWS = """<div id="prices">
<div class="price-row"><span class="item">{name}</span><span class="amount">₪{price}</span></div>
<DIV class='first price-row'><b><span class="item">{type} + {brand} / <b>x</span>
  <div><span class="amount big">{second}</span></div></div>
<div class="price-rows"><span class="item">no</span><span class="amount">₪2</span></div>
<div class="price-row"><span class="item">ask</span></div>
<div<!-- x --> class="price-row"><span class="item">no</span></div>
</div>
<div class="open-row"><span class="day">א׳–{last_day}</span><span class="time">{open}–{close}</span></div>
<div class="open-row"><span class="day">{day}</span><span class="time">{hours}</span></div>
<div class="open-row"><span class="day">שבת</span><span class="time off">סגור</span></div>"""


def _fill(template: str, values: Mapping[str, Column]) -> Column:
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def _choice(by: int, *values: str | Column) -> Column:
    """One of ``values``, by the remainder of ``p_size``."""
    columns = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.element_at(F.array(*columns), F.col("p_size") % by + 1)


def rendered_pages(parts: DataFrame) -> DataFrame:
    """``page_id, url, html`` from ``part``.

    A row of ``part`` is a hundred bytes and a page of it thousands, so a file that is one
    task to Spark holds pages for many: the rows are dealt out before they are rendered.
    """
    tasks = min(-(-parts.count() // _TASK_ROWS), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = parts.repartition(tasks) if tasks > 1 else parts
    size = F.col("p_size").cast("string")
    values = {
        "key": F.col("p_partkey").cast("string"),
        "name": F.col("p_name"),
        "brand": F.col("p_brand"),
        "type": F.col("p_type"),
        "size": size,
        "price": F.col("p_retailprice").cast("decimal(10,2)").cast("string"),
        "host": F.concat(F.lit("www."), F.col("p_type"), F.lit(".Example.com")),
        "lang": _choice(5, ' lang=""', "", *[" lang='he'"] * 3),
        "last_day": _choice(4, "ב׳", "ג׳", "ד׳", "ה׳"),
        "open": F.lpad((F.col("p_size") % 6 + 6).cast("string"), 2, "0"),
        "close": (F.col("p_size") % 8 + 15).cast("string"),
        "day": _choice(4, "שישי", "ו'", "יום ו", "ו׳, חג"),
        "hours": _choice(4, "08:15–13", "8–11, 16:30–20", "10—99", "10-12"),
        "second": _choice(
            6,
            F.concat(F.lit("&#8362;"), size, F.lit("+")),
            F.concat(size, F.lit(",50 EUR")),
            F.concat(F.lit("$1,"), F.lpad(size, 3, "0")),
            F.concat(F.lit("1."), F.lpad(size, 3, "0"), F.lit(",50&nbsp;€")),
            F.concat(size, F.lit(" min")),
            F.concat(F.lit("¥12000000"), size),
        ),
    }
    values["title"] = F.when(
        F.col("p_size") % 7 != 0, _fill("<TITLE>\n  {name} &middot; {brand}\n</TITLE>", values)
    ).otherwise(F.lit(""))
    values["rows"] = F.when(F.col("p_size") % 11 != 0, _fill(_ROWS, values)).otherwise(F.lit(""))
    return parts.select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("https://"), values["host"], F.lit("/p/"), values["key"]).alias("url"),
        _fill(_TEMPLATE, values).alias("html"),
    )
