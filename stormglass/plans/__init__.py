from .catalogue import all_queries, entry_query

__all__ = ["all_queries", "entry_query"]
