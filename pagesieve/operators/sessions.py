"""Sessions: runs of rows of one key without a gap between neighbours.

Rows are cut into slices of time of a key. A slice finds its own runs, and one row for
each key and slice tells later slices how far earlier ones reach and where the session
that reaches so far began. A busy key is therefore as many tasks as it has slices, and a
session over many slices is summed before the last shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, on: str, time: str, gap: int, width: int) -> DataFrame:
    """``on, start, end, n``: sessions of ``rows``, with their first and last time.

    A row that comes more than ``gap`` after the one before it opens a session, as with
    Spark's own session window. Times are whole numbers, ``width`` is the length of a slice. Rows without a key or time are in
    no session; rows of one time are in one session and count one by one.
    """
    at = F.col(time)
    return merged_sessions(rows.select(on, at.alias("start"), at.alias("end"), F.lit(1).alias("n")), on, gap, width)


def merged_sessions(spans: DataFrame, on: str, gap: int, width: int) -> DataFrame:
    """``on, start, end, n``: sessions of ``spans (on, start, end, n)``, which may be rows
    or sessions found before. Counts of spans that meet are added."""
    known = F.col(on).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    sliced = spans.filter(known).withColumn("slice", F.floor(F.col("start") / F.lit(width)))
    in_slice = Window.partitionBy(on, "slice").orderBy("start")
    before = F.max("end").over(in_slice.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("before").isNull() | (F.col("start") > F.col("before") + gap)
    first = F.last(F.when(opens, F.col("start")), ignorenulls=True).over(in_slice.rowsBetween(Window.unboundedPreceding, 0))
    runs = (
        sliced.withColumn("before", before)
        .withColumn("first", first)
        .groupBy(on, "slice", "first")
        .agg(F.max("end").alias("end"), F.sum("n").alias("n"))
    )
    # Runs of a slice come in order, so those beyond the reach of earlier slices are its last ones.
    apart = lambda start: F.col("reach").isNull() | (F.col(start) > F.col("reach") + gap)
    earlier = Window.partitionBy(on).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        runs.groupBy(on, "slice")
        .agg(F.max("end").alias("top"), F.max("first").alias("last"))
        .withColumn("reach", F.max("top").over(earlier))
        .withColumn("carry", F.max(F.when(apart("last"), F.col("last"))).over(earlier))
        .select(on, "slice", "reach", "carry")
    )
    start = F.when(apart("first"), F.col("first")).otherwise(F.col("carry"))
    return (
        runs.join(carried, [on, "slice"])
        .groupBy(on, start.alias("start"))
        .agg(F.max("end").alias("end"), F.sum("n").alias("n"))
    )
