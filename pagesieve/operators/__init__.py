from pagesieve.operators.asof import asof_join
from pagesieve.operators.broken import broken_links, broken_targets
from pagesieve.operators.hours import opening_hours
from pagesieve.operators.intervals import interval_join, overlap_join
from pagesieve.operators.links import link_counts, page_images, page_links
from pagesieve.operators.metadata import named_meta_tags, page_metadata
from pagesieve.operators.prices import price_rows
from pagesieve.operators.rows import RowPattern, class_rows
from pagesieve.operators.sessions import merged_sessions, sessions
from pagesieve.operators.text import page_text

__all__ = [
    "RowPattern",
    "asof_join",
    "broken_links",
    "broken_targets",
    "class_rows",
    "interval_join",
    "link_counts",
    "merged_sessions",
    "named_meta_tags",
    "opening_hours",
    "overlap_join",
    "page_images",
    "page_links",
    "page_metadata",
    "page_text",
    "price_rows",
    "sessions",
]
