"""Visible text. No shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagesieve.functions import visible_text


def page_text(pages: DataFrame) -> DataFrame:
    """``page_id, text``, one row per page."""
    return pages.select("page_id", visible_text(pages.html).alias("text"))
