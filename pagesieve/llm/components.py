"""Connected components of a table of links, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.storage import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link to another; root is its least node.

    In each round every node ties itself and its neighbours to the least of them, until
    all nodes of a component hang on its least node. Rounds grow with the logarithm of
    the longest path. A node with very many links is one row for each task after partial
    minima, and its links are joined back by a join that Spark can split. Links to
    itself, repeated links and links with a null end are left out.
    """
    edges = stored(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.hash("node", "root").cast("long"))).first()
        if (n, mark) == before or n == 0:
            return edges
        before = (n, mark)
        both = edges.select("node", "root").union(edges.select("root", "node")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
        tied = both.join(least, "u").select(F.col("v").alias("node"), F.col("least").alias("root"))
        own = least.select(F.col("u").alias("node"), F.col("least").alias("root"))
        edges = stored(tied.union(own).filter(F.col("node") != F.col("root")).distinct(), "links")
