"""Two-part rows of a page: a name and a value inside a repeated element.

Class names belong to a site, so the patterns are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions import visible_text
from pagesieve.functions.markup import class_tag, content, cut_at, first_group


@dataclass(frozen=True)
class RowPattern:
    """Java regular expressions. ``row`` matches a row's start tag; ``name`` and
    ``value`` capture the markup of the two parts in group 1."""

    row: str
    name: str
    value: str


def class_rows(
    row: tuple[str, str], name: tuple[str, str], value: tuple[str, str]
) -> RowPattern:
    """A pattern from three ``(tag, class)`` pairs."""

    def element(tag: str, cls: str) -> str:
        return rf"(?i){class_tag(tag, cls)}({content(tag)})"

    return RowPattern(rf"(?i){class_tag(*row)}", element(*name), element(*value))


def page_rows(pages: DataFrame, pattern: RowPattern) -> DataFrame:
    """``page_id, pos, name, value``: the text of both parts, rows in page order.

    A row reaches from its start tag to the next one. Most pages of a crawl have
    no such row; the filter drops them before anything else is done. Patterns from
    ``class_rows`` take time linear in the page; for others that is up to the caller.
    """
    pieces = cut_at(pages.html, pattern.row)

    def part(regex: str) -> Column:
        return visible_text(first_group(F.col("piece"), regex))

    return (
        pages.filter(pages.html.rlike(pattern.row))
        .select("page_id", F.posexplode(pieces).alias("pos", "piece"))
        .select(
            "page_id",
            "pos",
            part(pattern.name).alias("name"),
            part(pattern.value).alias("value"),
        )
    )
