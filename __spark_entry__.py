"""

The first five queries read ``pages``. The ``rendered_*`` queries read pages that
Spark renders from ``part`` (see ``rendered.py``); their SQL says what must come back
from ``part`` alone, without looking at any markup. The ``facts_*`` queries read the
one-scan table of ``pages`` and have the SQL of the direct jobs. The joins read ``pages``,
``events`` and ``orders``.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve import operators as op
from pagesieve import plans
from pagesieve.sources import read_pages
from rendered import HOURS_PATTERN, PRICE_PATTERN, rendered_pages

Query = Callable[[SparkSession, str], DataFrame]


try:
    import corpus_pipeline
    from pagesieve.llm.queries import ORACLE_SQL as LLM_SQL
    from pagesieve.llm.queries import QUERIES

    LLM_QUERIES = QUERIES | {"pipeline": corpus_pipeline.run}
except ModuleNotFoundError as missing:
    # The subpackage may be absent as a whole, or what it alone needs (extra "llm").
    own = ("corpus_pipeline", "pagesieve.llm", "numpy", "pyarrow", "public_tokenizers", "xxhash", "zstandard")
    if not str(missing.name).startswith(own):
        raise
    LLM_QUERIES, LLM_SQL = {}, {}


def entry(spark: SparkSession) -> DataFrame:
    """Links of every page of the smallest data set."""
    return queries()["page_links"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return library_queries() | {name: _importable(q) for name, q in LLM_QUERIES.items()}


def _importable(query: Query) -> Query:
    """``query`` with this folder on the path of Python workers, wherever Spark was started."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parent))
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return library_sql() | LLM_SQL


def library_queries() -> dict[str, Query]:
    def on_pages(job: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: job(
            read_pages(spark, f"{sf_dir}/pages.parquet")
        )

    def on_rendered(job: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: job(
            rendered_pages(spark.read.parquet(f"{sf_dir}/part.parquet"))
        )

    def on_facts(job: Callable[[DataFrame], DataFrame]) -> Query:
        return on_pages(lambda pages: job(plans.page_facts(pages)))

    return {
        "page_metadata": on_pages(op.page_metadata),
        "page_links": on_pages(op.page_links),
        "link_counts_by_kind": on_pages(lambda p: op.link_counts(p, "kind")),
        "link_counts_by_host": on_pages(lambda p: op.link_counts(p, "host")),
        "page_text": on_pages(op.page_text),
        "broken_links": on_pages(op.broken_links),
        "broken_targets": on_pages(op.broken_targets),
        "orders_at_events": orders_at_events,
        "overlapping_order_spans": overlapping_order_spans,
        "latest_order_before_event": latest_order_before_event,
        "user_sessions": user_sessions,
        "facts_metadata": on_facts(plans.facts_metadata),
        "facts_links": on_facts(plans.facts_links),
        "facts_link_counts_by_kind": on_facts(lambda f: plans.facts_link_counts(f, "kind")),
        "facts_link_counts_by_host": on_facts(lambda f: plans.facts_link_counts(f, "host")),
        "facts_text": on_facts(plans.facts_text),
        "rendered_metadata": on_rendered(op.page_metadata),
        "rendered_named_meta": on_rendered(op.named_meta_tags),
        "rendered_links": on_rendered(op.page_links),
        "rendered_images": on_rendered(op.page_images),
        "rendered_link_counts_by_kind": on_rendered(lambda p: op.link_counts(p, "kind")),
        "rendered_link_counts_by_host": on_rendered(lambda p: op.link_counts(p, "host")),
        "rendered_text": on_rendered(op.page_text),
        "rendered_price_rows": on_rendered(lambda p: op.price_rows(p, PRICE_PATTERN)),
        "rendered_opening_hours": on_rendered(lambda p: op.opening_hours(p, HOURS_PATTERN)),
    }


#: Events come this many days after the orders they are joined with.
DAYS_APART = 9131
DAY = 86_400_000_000


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, at``: micros of the event, in the years of the orders."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "user_id", (_micros("ts") - DAYS_APART * DAY).alias("at"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", "o_totalprice", _micros("o_orderdate").alias("ordered"))


def orders_at_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders open when an event happens; an order is open for a minute per 1000 of its price."""
    open_for = (F.col("o_totalprice") / 1000).cast("long") * 60_000_000
    orders = _orders(spark, sf_dir).withColumn("until", F.col("ordered") + open_for)
    rows = op.interval_join(_events(spark, sf_dir), orders, "at", "ordered", "until")
    return rows.select("event_id", "o_orderkey", (F.col("at") - F.col("ordered")).alias("micros"))


def overlapping_order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders of a customer that are less than their spans of days apart."""
    days = F.col("o_orderkey") % 40
    orders = _orders(spark, sf_dir).select(
        "o_custkey", "o_orderkey", F.col("ordered").alias("low"), (F.col("ordered") + days * DAY).alias("high")
    )
    other = orders.withColumnsRenamed({"o_orderkey": "other_key", "low": "other_low", "high": "other_high"})
    pairs = op.overlap_join(orders, other, ("low", "high"), ("other_low", "other_high"), ("o_custkey",))
    return pairs.filter("o_orderkey < other_key").select("o_custkey", "o_orderkey", "other_key")


def latest_order_before_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select(F.col("o_custkey").alias("user_id"), "ordered", "o_orderkey")
    rows = op.asof_join(_events(spark, sf_dir), orders, "user_id", "at", "ordered", width=30 * DAY)
    return rows.select("event_id", "user_id", "latest.o_orderkey", (F.col("at") - F.col("latest.ordered")).alias("micros"))


#: A session ends after so many hours without an event.
SESSION_HOURS = 6


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.sessions(_events(spark, sf_dir), "user_id", "at", SESSION_HOURS * DAY // 24, width=DAY)
    return rows.select("user_id", F.col("start").alias("start_micros"), F.col("end").alias("end_micros"), F.col("n").alias("n_events"))


_HIDDEN = "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
_TITLE = "(?is)<title[^>]*>(.*?)</title>"
_SHOWN = f"regexp_replace(html, '{_HIDDEN}', ' ', 'g')"


def _plain(sql: str) -> str:
    """Decoded and tidied text; "&amp;" comes last so that nothing decodes twice."""
    for entity, char in {
        "&lt;": "<", "&gt;": ">", "&quot;": '"', "&middot;": "·", "&copy;": "©", "&amp;": "&",
    }.items():
        sql = f"replace({sql}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({sql}, '\s+', ' ', 'g'))"


_PAGE_LINKS = f"""
    SELECT row_no, page_id, {_plain("raw")} AS href
    FROM (
        SELECT row_no, page_id,
               unnest(regexp_extract_all(shown, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS raw
        FROM (SELECT row_number() OVER () AS row_no, page_id, {_SHOWN} AS shown FROM pages)
    )
"""
_KIND = """
    CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN lower(split_part(href, ':', 1))
         WHEN href LIKE '#%' THEN 'fragment'
         WHEN href LIKE '//%' THEN 'scheme-relative'
         ELSE 'relative' END
"""
_HOST = "nullif(lower(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '')"

_ORIGIN = "lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*'))"
_ADDRESS = "lower(regexp_extract({0}, '^[A-Za-z]+://[^/?#]*')) || coalesce(nullif(regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract({0}, '^[^?#]*([?][^#]*)?', 1)"
#: Internal links with their targets. The pages have no dot segments in their links.
_INTERNAL = f"""
    SELECT row_no, page_id, href, target, count(*) AS n FROM (
        SELECT l.row_no, l.page_id, href, {_ORIGIN} AS origin, CASE
            WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {_ADDRESS.format("href")}
            WHEN href LIKE '//%' THEN {_ADDRESS.format("split_part(url, ':', 1) || ':' || href")}
            WHEN href LIKE '/%' THEN {_ADDRESS.format(f"{_ORIGIN} || href")}
            WHEN href = '' OR href LIKE '#%' THEN {_ADDRESS.format("url")}
            WHEN href LIKE '?%' THEN {_ADDRESS.format("regexp_extract(url, '^[^?#]*') || href")}
            ELSE {_ADDRESS.format("regexp_extract(regexp_extract(url, '^[^?#]*'), '^.*/') || href")} END AS target
        FROM ({_PAGE_LINKS}) l JOIN (SELECT row_number() OVER () AS row_no, url FROM pages) USING (row_no)
    ) WHERE split_part(target, '/', 3) = split_part(origin, '/', 3) GROUP BY ALL
"""
_BROKEN = f"SELECT * FROM ({_INTERNAL}) l WHERE NOT EXISTS (SELECT 1 FROM pages WHERE {_ADDRESS.format('url')} = l.target)"
_EVENT_TIME = f"epoch_us(ts) - {DAYS_APART * DAY}"

_PRICE = "CAST(p_retailprice AS DECIMAL(10,2))"
_SECOND = """['₪' || p_size || '+', p_size || ',50 EUR', '$1,' || lpad(CAST(p_size AS VARCHAR), 3, '0'),
    '1.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ',50 €', p_size || ' min',
    '¥12000000' || p_size][p_size % 6 + 1]"""
_RENDERED_LINKS = """
    SELECT page_id, unnest(links) AS link FROM (
        SELECT p_partkey AS page_id, [
            {'href': 'https://www.' || p_type || '.Example.com/p/' || p_partkey || '?a=1&b=%zz',
             'kind': 'https', 'host': 'www.' || lower(p_type) || '.example.com', 'n': 2},
            {'href': 'tel:+100' || p_partkey, 'kind': 'tel', 'host': NULL, 'n': 1},
            {'href': '#prices', 'kind': 'fragment', 'host': NULL, 'n': 1},
            {'href': '/size/' || p_size, 'kind': 'relative', 'host': NULL, 'n': 1},
            {'href': '//maps.example.net/חיפוש+' || p_partkey,
             'kind': 'scheme-relative', 'host': 'maps.example.net', 'n': 1}
        ] AS links FROM part)
"""


def _rendered_counts(key: str) -> str:
    return f"""
        SELECT {key}, CAST(sum(n) AS BIGINT) AS n_links, count(DISTINCT page_id) AS n_pages
        FROM (SELECT page_id, link.{key} AS {key}, link.n AS n FROM ({_RENDERED_LINKS}))
        GROUP BY {key}
    """


def library_sql() -> dict[str, str]:
    sql = {
        "page_metadata": f"""
            SELECT page_id,
                   CASE WHEN regexp_matches(html, '(?i)<html[^>]*\\slang=')
                        THEN regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) END AS lang,
                   CASE WHEN regexp_matches(html, '{_TITLE}')
                        THEN {_plain(f"regexp_extract(html, '{_TITLE}', 1)")} END AS title
            FROM pages
        """,
        "page_links": f"""
            SELECT page_id, href, {_KIND} AS kind, {_HOST} AS host, count(*) AS n
            FROM ({_PAGE_LINKS}) GROUP BY row_no, page_id, href
        """,
        "link_counts_by_kind": f"""
            SELECT kind, count(*) AS n_links, count(DISTINCT row_no) AS n_pages
            FROM (SELECT row_no, {_KIND} AS kind FROM ({_PAGE_LINKS})) GROUP BY kind
        """,
        "link_counts_by_host": f"""
            SELECT host, count(*) AS n_links, count(DISTINCT row_no) AS n_pages
            FROM (SELECT row_no, {_HOST} AS host FROM ({_PAGE_LINKS})) GROUP BY host
        """,
        "page_text": f"""
            SELECT page_id,
                   {_plain(f"regexp_replace(regexp_replace({_SHOWN}, '{_TITLE}', ' ', 'g'), '<[a-zA-Z/!?][^<>]*>?', ' ', 'g')")} AS text
            FROM pages
        """,
        "broken_links": f"SELECT page_id, href, target, n FROM ({_BROKEN})",
        "broken_targets": f"""
            SELECT target, CAST(sum(n) AS BIGINT) AS n_links, count(*) AS n_pages
            FROM ({_BROKEN}) GROUP BY target
        """,
        "orders_at_events": f"""
            SELECT event_id, o_orderkey, {_EVENT_TIME} - epoch_us(o_orderdate) AS micros
            FROM events JOIN orders
            ON {_EVENT_TIME} BETWEEN epoch_us(o_orderdate)
               AND epoch_us(o_orderdate) + CAST(floor(o_totalprice / 1000) AS BIGINT) * 60000000
        """,
        "overlapping_order_spans": f"""
            SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other_key FROM orders a JOIN orders b
            ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
            AND epoch_us(a.o_orderdate) <= epoch_us(b.o_orderdate) + b.o_orderkey % 40 * {DAY}
            AND epoch_us(b.o_orderdate) <= epoch_us(a.o_orderdate) + a.o_orderkey % 40 * {DAY}
        """,
        "latest_order_before_event": f"""
            SELECT event_id, any_value(user_id) AS user_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
                   any_value({_EVENT_TIME}) - epoch_us(max(o_orderdate)) AS micros
            FROM events LEFT JOIN orders ON o_custkey = user_id AND epoch_us(o_orderdate) <= {_EVENT_TIME}
            GROUP BY event_id
        """,
        "user_sessions": f"""
            SELECT user_id, min(t) AS start_micros, max(t) AS end_micros, count(*) AS n_events FROM (
                SELECT user_id, t, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY t) AS session FROM (
                    SELECT user_id, t, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {SESSION_HOURS * DAY // 24}, true) AS opens
                    FROM (SELECT user_id, {_EVENT_TIME} AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)))
            GROUP BY user_id, session
        """,
        "rendered_metadata": """
            SELECT p_partkey AS page_id,
                   CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'he' END AS lang,
                   CASE WHEN p_size % 7 <> 0 THEN p_name || ' · ' || p_brand END AS title
            FROM part
        """,
        "rendered_named_meta": f"""
            SELECT p_partkey AS page_id, 'description' AS name, p_brand || ' & ' || p_type AS content
            FROM part
            UNION ALL SELECT p_partkey, 'og:title', p_name || ' > all' FROM part
            UNION ALL SELECT p_partkey, 'product:price', CAST({_PRICE} AS VARCHAR) FROM part
            UNION ALL SELECT p_partkey, 'description', 'again' || p_size FROM part
        """,
        "rendered_links": f"""
            SELECT page_id, link.href AS href, link.kind AS kind, link.host AS host,
                   CAST(link.n AS BIGINT) AS n
            FROM ({_RENDERED_LINKS})
        """,
        "rendered_images": """
            SELECT p_partkey AS page_id, 'p' || p_partkey || '.jpg' AS href, 'relative' AS kind,
                   CAST(NULL AS VARCHAR) AS host, CAST(1 AS BIGINT) AS n, 'a > ' || p_name AS alt
            FROM part
            UNION ALL
            SELECT p_partkey, 'plain.png', 'relative', NULL, 1, NULL FROM part
        """,
        "rendered_link_counts_by_kind": _rendered_counts("kind"),
        "rendered_link_counts_by_host": _rendered_counts("host"),
        "rendered_text": f"""
            SELECT p_partkey AS page_id,
                   p_name || ' ' || p_brand || ' order call prices size map '
                   || CASE WHEN p_size % 11 = 0 THEN '' ELSE
                      p_name || ' ₪' || {_PRICE} || ' ' || p_type || ' + ' || p_brand || ' / x '
                      || {_SECOND} || ' no ₪2 ask class="price-row"> no א׳–'
                      || ['ב׳', 'ג׳', 'ד׳', 'ה׳'][p_size % 4 + 1] || ' '
                      || lpad(CAST(p_size % 6 + 6 AS VARCHAR), 2, '0') || '–' || (p_size % 8 + 15)
                      || ' ' || ['שישי 08:15–13', 'ו'' 8–11, 16:30–20', 'יום ו 10—99', 'ו׳, חג 10-12'][p_size % 4 + 1]
                      || ' שבת סגור ' END
                   || 'order © ' || p_name || ' 1 < 2 "' || p_brand || '" &lt;' AS text
            FROM part
        """,
        "rendered_price_rows": f"""
            SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS pos, p_name AS name,
                   '₪' AS currency, CAST({_PRICE} AS DECIMAL(30,6)) AS amount, false AS open_ended
            FROM part WHERE p_size % 11 <> 0
            UNION ALL
            SELECT p_partkey, 1, p_type || ' + ' || p_brand || ' / x',
                   ['₪', 'EUR', '$', '€', NULL, '¥'][p_size % 6 + 1],
                   CAST([CAST(p_size AS VARCHAR), p_size || '.5', CAST(1000 + p_size AS VARCHAR),
                    (1000 + p_size) || '.5', NULL, '12000000' || p_size][p_size % 6 + 1] AS DECIMAL(30,6)),
                   CASE WHEN p_size % 6 <> 4 THEN p_size % 6 = 0 END
            FROM part WHERE p_size % 11 <> 0
            UNION ALL
            SELECT p_partkey, 2, 'ask', NULL, NULL, NULL FROM part WHERE p_size % 11 <> 0
        """,
        "rendered_opening_hours": """
            WITH shop AS (SELECT *, p_size % 4 AS shape FROM part WHERE p_size % 11 <> 0)
            SELECT p_partkey AS page_id, CAST(unnest(range(1, p_size % 4 + 3)) AS INTEGER) AS dow,
                   CAST(p_size % 6 + 6 AS INTEGER) AS open_hour,
                   CAST(p_size % 8 + 15 AS INTEGER) AS close_hour, false AS closed,
                   0 AS open_minute, 0 AS close_minute
            FROM shop
            UNION ALL SELECT p_partkey, 6, 8, 13, false, 15, 0 FROM shop WHERE shape = 0
            UNION ALL SELECT p_partkey, 6, 8, 11, false, 0, 0 FROM shop WHERE shape = 1
            UNION ALL SELECT p_partkey, 6, 16, 20, false, 30, 0 FROM shop WHERE shape = 1
            UNION ALL SELECT p_partkey, 6, NULL, NULL, false, NULL, NULL FROM shop WHERE shape = 2
            UNION ALL SELECT p_partkey, 6, 10, 12, false, 0, 0 FROM shop WHERE shape = 3
            UNION ALL SELECT p_partkey, NULL, 10, 12, false, 0, 0 FROM shop WHERE shape = 3
            UNION ALL SELECT p_partkey, 7, NULL, NULL, true, NULL, NULL FROM shop
        """,
    }
    direct = {
        "facts_metadata": "page_metadata",
        "facts_links": "page_links",
        "facts_link_counts_by_kind": "link_counts_by_kind",
        "facts_link_counts_by_host": "link_counts_by_host",
        "facts_text": "page_text",
    }
    return sql | {facts: sql[job] for facts, job in direct.items()}
