"""As-of join: beside each row the latest row of another table, of the same key.

Both tables become one, ordered by time inside a slice of time of a key, and each left
row takes the last right row before it in its slice. Where there is none it takes the
carry: the last right row of the nearest earlier slice that has one. Carries come from one row
for each key and slice, so a busy key is as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, width: int) -> DataFrame:
    """All rows of ``left`` and the struct ``latest``: the row of ``right`` with the same
    ``on`` and the greatest ``right_time`` that is not behind ``left_time``.

    Times are whole numbers, ``width`` is the length of a slice. Of right rows with one
    time the greatest counts, by their columns in order. ``latest`` is null where there is
    no such row or a key or time is null. An older column of that name is replaced.
    """
    left = left.drop("latest")
    later = right.filter(F.col(on).isNotNull() & F.col(right_time).isNotNull())
    slice_ = F.floor(F.col("time") / F.lit(width)).alias("slice")
    none = F.lit(None)
    row_type, left_type = later.select(F.struct("*")).schema[0].dataType, left.select(F.struct("*")).schema[0].dataType
    asking = left.select(
        F.col(on).alias("key"), F.col(left_time).alias("time"), F.struct("*").alias("asked"), none.cast(row_type).alias("row")
    )
    told = later.select(
        F.col(on).alias("key"), F.col(right_time).alias("time"), none.cast(left_type).alias("asked"), F.struct("*").alias("row")
    )
    both = asking.union(told).select("*", slice_)
    # Right rows stand before left ones of the same time.
    in_slice = Window.partitionBy("key", "slice").orderBy("time", F.col("asked").isNotNull(), "row")
    seen = F.last("row", ignorenulls=True).over(in_slice.rowsBetween(Window.unboundedPreceding, 0))
    known = F.col("key").isNotNull() & F.col("time").isNotNull()
    whole, lost = both.filter(known), asking.filter(~known)
    answered = whole.select("key", "slice", "asked", seen.alias("own")).filter("asked IS NOT NULL")
    last = whole.groupBy("key", "slice").agg(F.max(F.when(F.col("row").isNotNull(), F.struct("time", "row"))).alias("last"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("key", "slice", F.last("last.row", ignorenulls=True).over(before).alias("carry"))
    found = answered.join(carried, ["key", "slice"]).select("asked", F.coalesce("own", "carry").alias("latest"))
    return found.union(lost.select("asked", none.cast(row_type))).select("asked.*", "latest")
