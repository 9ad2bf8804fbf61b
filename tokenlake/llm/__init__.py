"""Training-data operators (deduplication, quality, packing, token counts).

Nothing outside this subpackage imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
