"""Training-data operators: tokenisation, filtering, deduplication, extraction, archives and search.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
