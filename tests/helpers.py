"""Small helpers shared by the tests."""

from pyspark.sql import functions as F

from pagesieve.sources import PAGE_SCHEMA


def pages(spark, *markup):
    """A page table with ids 0, 1, ... and the given markup."""
    rows = [(i, f"https://page{i}.example/", html) for i, html in enumerate(markup)]
    return spark.createDataFrame(rows, PAGE_SCHEMA)


def apply(spark, function, values):
    """``function`` over a list of strings, in order."""
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "i int, x string")
    return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
