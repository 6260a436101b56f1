from pagesieve.plans.one_scan import (
    facts_link_counts,
    facts_links,
    facts_metadata,
    facts_named_meta,
    facts_text,
    page_facts,
    store_facts,
)

__all__ = [
    "facts_link_counts",
    "facts_links",
    "facts_metadata",
    "facts_named_meta",
    "facts_text",
    "page_facts",
    "store_facts",
]
