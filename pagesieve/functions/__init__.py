"""Column expressions over one page's markup. No UDFs: built-ins only."""

from pagesieve.functions.arrays import let, value_counts
from pagesieve.functions.entities import decode_entities
from pagesieve.functions.markup import (
    attribute,
    language,
    named_meta,
    start_tags,
    targets,
    title,
    visible_text,
)
from pagesieve.functions.urls import link_host, link_kind, resolve

__all__ = [
    "attribute",
    "decode_entities",
    "language",
    "let",
    "link_host",
    "link_kind",
    "named_meta",
    "resolve",
    "start_tags",
    "targets",
    "title",
    "value_counts",
    "visible_text",
]
