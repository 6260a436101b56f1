"""URL filters: listed rules first, then association rules mined from labelled pages.

A url is cut into tokens: its scheme, the labels of its host, the segments of its path
and the names of its query. Tokens that too few bad urls have are left out, and those that occur in the same labelled
urls are one item, because every combination of them would be the same rule again. Spark's
FP-growth finds the item combinations that occur together with a bad label often enough
(support) and seldom without one (confidence). The rules that are left match through an
inverted index: each stands under its rarest item only, and a url looks its own items up
there. A url has an item if it has one of its tokens.

Defined results
    null url, or no "://"      host and path empty, no rule, allowed
    null or repeated page_id   every row is judged by its own url; labels of a repeated
                               id count as bad if any of them is
    no labels, empty table     no mined rules; only the listed rules decide
    columns of other names     not read
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.llm.storage import stored

BAD = "label:bad"

#: Parameters of the mining. The share also bounds the items that FP-growth keeps on the
#: driver: 1000 for each token of a url.
LEAST_SUPPORT = 0.001
LEAST_COUNT = 10
LEAST_CONFIDENCE = 0.6


@dataclass(frozen=True)
class ListedRule:
    """Allow or block what lies under a host (with its subdomains) and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From after the first "://" up to "/", "?", "#" or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[ListedRule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        it = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, it).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of ``url``, sorted; each begins with the part it is from."""

    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    whole = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(whole, r"(?s)^[^?#]*\?([^#]*)", 1)
    tokens = F.concat(
        named("scheme:", F.array(F.lower(F.regexp_extract(whole, r"(?s)^(.*?)://", 1)))),
        named("host:", F.split(host_of(whole), r"\.", -1)),
        named("path:", F.split(F.lower(path_of(whole)), "/", -1)),
        named(
            "query:",
            F.transform(F.split(F.lower(query), "&", -1), lambda x: F.split_part(x, F.lit("="), F.lit(1))),
        ),
    )
    return F.array_sort(F.array_distinct(tokens))


def merged_items(rows: DataFrame, least_bad: float) -> DataFrame:
    """``token, item`` of the tokens in ``rows (id, tokens, bad)`` that enough bad rows have.

    Tokens of the same rows get the first of them as their item. Equal sets of rows are
    told by their size and two 64-bit sums over the ids. No more tokens come together than
    one url has.
    """
    held = rows.select("id", "bad", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(
        F.count_if("bad").alias("n_bad"),
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("one"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("two"),
    )
    same = Window.partitionBy("n", "one", "two")
    frequent = counts.filter(F.col("n_bad") >= least_bad)
    return frequent.select("token", F.min("token").over(same).alias("item"))


def items_of(rows: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """``key`` and the distinct ``items`` of ``rows (key, tokens)``, where there are any."""
    held = rows.select(key, F.explode("tokens").alias("token")).join(items, "token")
    return held.groupBy(key).agg(F.collect_set("item").alias("items"))


def mined_rules(
    urls: DataFrame,
    *,
    least_support: float = LEAST_SUPPORT,
    least_count: int = LEAST_COUNT,
    count_up_to: float = float("inf"),
    least_confidence: float = LEAST_CONFIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """``needed, key, support, confidence`` of the rules in ``urls (url, bad)``, and the
    ``token, item`` that they are made of.

    ``key`` is the item of the rule that the fewest labelled urls have (the first by
    name among equals). The support is the share of all labelled urls that have the
    items and are bad; FP-growth needs it as a share, so ``least_count`` is turned into one.
    Where the count is more than the share ``count_up_to`` of the urls, that share is enough.
    """
    marked = urls.select(
        F.monotonically_increasing_id().alias("id"), url_tokens(F.col("url")).alias("tokens"), "bad"
    )
    rows = stored(marked, "url-tokens")
    total = rows.count()
    support = max(least_support, min(count_up_to, least_count / total)) if total else 2.0
    least_bad = support * total if support <= 1 else float("inf")
    # Written, so that Spark knows its size and broadcasts it only if it is small.
    items = stored(merged_items(rows, least_bad), "url-items")
    if support > 1:
        schema = "needed array<string>, key string, support double, confidence double"
        return rows.sparkSession.createDataFrame([], schema), items
    # A row without a frequent token counts for the support, too.
    found = rows.select("id", "bad").join(items_of(rows, "id", items), "id", "left")
    held = F.coalesce("items", F.array().cast("array<string>"))
    baskets = found.select(
        F.when(F.col("bad"), F.array_append(held, F.lit(BAD))).otherwise(held).alias("items")
    )
    baskets = stored(baskets, "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=least_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.array_sort("antecedent").alias("needed"), "support", "confidence"
    )
    single = model.freqItemsets.filter(F.size("items") == 1).select(
        F.col("items")[0].alias("item"), "freq"
    )
    rarest = (
        rules.select("needed", F.explode("needed").alias("item"))
        .join(single, "item")
        .groupBy("needed")
        .agg(F.min(F.struct("freq", "item")).alias("least"))
    )
    rules = rules.join(rarest, "needed").select(
        "needed", F.col("least.item").alias("key"), "support", "confidence"
    )
    return rules, items


def matching_urls(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct ``url`` of ``urls`` that some rule matches.

    The index is written first: Spark then knows its size, and broadcasts it only if it
    is small.
    """
    index = stored(rules.select("key", "needed"), "url-index")
    distinct = urls.filter(F.col("url").isNotNull()).select("url").distinct()
    tokens = distinct.select("url", url_tokens(F.col("url")).alias("tokens"))
    looked_up = items_of(tokens, "url", items).select("url", "items", F.explode("items").alias("key"))
    return (
        looked_up.join(index, "key")
        .filter(F.size(F.array_except("needed", "items")) == 0)
        .select("url")
        .distinct()
    )


def judged_urls(
    pages: DataFrame,
    labels: DataFrame,
    listed: Sequence[ListedRule],
    *,
    page_id: str = "page_id",
    url: str = "url",
    **mining,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for every row of ``pages``.

    ``labels (doc_id, quality, toxic)`` mark the page of that id: bad is quality 0 or
    toxic 1. ``mined`` says that a mined rule matches; it decides where no listed rule
    fits.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")
    )
    rules, items = mined_rules(rows.join(marks, "page_id"), **mining)
    hits = matching_urls(rows, rules, items).withColumn("mined", F.lit(True))
    rule = F.col("listed")
    return (
        rows.join(hits, "url", "left")
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "mined")
        .withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
        .select(
            "page_id",
            "host",
            "path",
            rule["name"].alias("rule"),
            F.coalesce(
                rule["verdict"], F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))
            ).alias("verdict"),
            F.coalesce("mined", F.lit(False)).alias("mined"),
        )
    )
