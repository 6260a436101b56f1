from pagesieve.streaming.changes import append_changes, page_changes
from pagesieve.streaming.incremental import append_facts, stream_pages
from pagesieve.streaming.sessions import SessionTables

__all__ = ["SessionTables", "append_changes", "append_facts", "page_changes", "stream_pages"]
