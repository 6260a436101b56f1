"""Opening hours, one row per weekday and span of hours. No shuffle and no join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions import let
from pagesieve.operators.rows import RowPattern, page_rows

# Hebrew day letters and day names, 1 = Sunday.
HEBREW_DAYS = {
    "א": 1, "ב": 2, "ג": 3, "ד": 4, "ה": 5, "ו": 6, "ש": 7,
    "ראשון": 1, "שני": 2, "שלישי": 3, "רביעי": 4, "חמישי": 5, "שישי": 6, "שבת": 7,
}
HEBREW_CLOSED = "סגור"
HEBREW_DAY_WORDS = ("יום", "ימים", "ימי")

# Marks after a letter that stands for a day: geresh and what is typed for it.
_MARKS = "[׳'’`´]"
_DASH = r"\s*[–—-]\s*"
_LIST = r"\s*[,;]\s*"
_TIME = r"(\d{1,2})(?::(\d{2}))?"
_SPAN = rf"\A{_TIME}{_DASH}{_TIME}\z"


def _days(label: Column, days: Mapping[str, int], day_words: tuple[str, ...]) -> Column:
    """``array<int>`` of a label: a list of days and ranges, NULL for what is unknown."""
    bare = lambda text: F.regexp_replace(text, _MARKS, "")
    keys = (F.lit(x) for name, day in days.items() for x in (_unmarked(name), day))
    day_of = F.create_map(*keys)
    words = "|".join(day_words)
    text = bare(F.regexp_replace(label, rf"\A(?:{words})\s+", "") if words else label)

    def span(part: Column) -> Column:
        def ends_of(ends: Column) -> Column:
            day = lambda i: F.try_element_at(day_of, F.get(ends, i))
            known = F.size(ends) <= 2
            return F.when(
                known, F.struct(day(F.lit(0)).alias("first"), day(F.size(ends) - 1).alias("last"))
            )

        def run(e: Column) -> Column:
            days = F.sequence(e["first"], e["first"] + F.pmod(e["last"] - e["first"], F.lit(7)))
            known = e["first"].isNotNull() & e["last"].isNotNull()
            return F.when(known, F.transform(days, lambda d: (d - 1) % 7 + 1)).otherwise(
                F.array(F.lit(None).cast("int"))
            )

        return let(let(F.split(part, _DASH), ends_of), run)

    return F.flatten(F.transform(F.split(text, _LIST), span))


def _unmarked(name: str) -> str:
    return "".join(c for c in name if c not in _MARKS[1:-1])


def _spans(value: Column, closed_word: str) -> Column:
    """The spans of hours in a value; a span that cannot be read is all NULL.

    One replacement writes the four numbers of a span with colons between them, and the
    rest works on these.
    """

    def span(part: Column, numbers: Column) -> Column:
        # Where nothing was replaced there is no span; a span has a dash, numbers have none.
        return let(F.split(F.when(numbers != part, numbers), ":", -1), lambda f: read_of(part, f))

    def read_of(part: Column, fields: Column) -> Column:
        number = lambda i: F.get(fields, F.lit(i)).try_cast("int")
        minute = lambda i: F.coalesce(number(i), F.lit(0))
        read = F.struct(
            number(0).alias("open_hour"),
            minute(1).alias("open_minute"),
            number(2).alias("close_hour"),
            minute(3).alias("close_minute"),
        )

        def checked(x: Column) -> Column:
            sound = F.size(fields) == 4
            for hour, past in (("open_hour", "open_minute"), ("close_hour", "close_minute")):
                sound &= (x[hour] * 60 + x[past] <= 24 * 60) & (x[past] < 60)
            kept = lambda c: F.when(sound, x[c]).alias(c)
            return F.struct(
                *map(kept, ("open_hour", "open_minute", "close_hour", "close_minute")),
                (part == closed_word).alias("closed"),
            )

        return let(read, checked)

    return F.transform(
        F.split(value, _LIST),
        lambda part: let(F.regexp_replace(part, _SPAN, "$1:$2:$3:$4"), lambda n: span(part, n)),
    )


def opening_hours(
    pages: DataFrame,
    pattern: RowPattern,
    days: Mapping[str, int] = HEBREW_DAYS,
    closed_word: str = HEBREW_CLOSED,
    day_words: tuple[str, ...] = HEBREW_DAY_WORDS,
) -> DataFrame:
    """``page_id, dow, open_hour, close_hour, closed, open_minute, close_minute``.

    A label is a list of days and ranges of days, which may run over the end of the
    week; one of ``day_words`` may stand before it. What is not in ``days`` keeps its
    row, with ``dow`` NULL. A value is a list of spans; each is a row for each day.
    """
    return (
        page_rows(pages, pattern)
        .select(
            "page_id",
            _days(F.col("name"), days, day_words).alias("days"),
            _spans(F.col("value"), closed_word).alias("spans"),
        )
        .select("page_id", "spans", F.explode_outer("days").alias("dow"))
        .select("page_id", "dow", F.explode_outer("spans").alias("span"))
        .select(
            "page_id",
            "dow",
            "span.open_hour",
            "span.close_hour",
            "span.closed",
            "span.open_minute",
            "span.close_minute",
        )
    )
