"""Page metadata: language, title and named meta tags. No shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions import language, named_meta, start_tags, title


def page_metadata(pages: DataFrame) -> DataFrame:
    """``page_id, lang, title``, one row per page."""
    return pages.select(
        "page_id", language(pages.html).alias("lang"), title(pages.html).alias("title")
    )


def named_meta_tags(pages: DataFrame) -> DataFrame:
    """``page_id, name, content``, one row per named meta tag."""
    return pages.select("page_id", F.inline(named_meta(start_tags(pages.html, "meta"))))
