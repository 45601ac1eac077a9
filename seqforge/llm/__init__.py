"""Training-data operators: deduplication, quality, scoring, mixing, archives.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered queries and their SQL.
"""
