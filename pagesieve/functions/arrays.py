"""Array helpers that keep per-page work inside the page's own row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def value_counts(values: Column) -> Column:
    """``array<struct<value, n>>``: each distinct value with its number of copies.

    Sorting brings copies together, so a page with k links costs k log k and
    nothing has to be shuffled to count them.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered,
                lambda v, i: F.when(
                    (i == 0) | ~v.eqNullSafe(F.get(ordered, i - 1)),
                    F.struct(v.alias("value"), i.alias("at")),
                ),
            ),
            lambda run: run.isNotNull(),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda run, k: F.struct(
                    run["value"].alias("value"),
                    (F.coalesce(F.get(s, k + 1)["at"], F.size(ordered)) - run["at"])
                    .cast("bigint")
                    .alias("n"),
                ),
            ),
        )

    return let(F.array_sort(values), runs)
