from pagesieve.sources.pages import PAGE_SCHEMA, read_pages

__all__ = ["PAGE_SCHEMA", "read_pages"]
