"""Training-data operators: deduplication, scoring, filtering and tokenisation.

Nothing outside this subpackage imports it; ``queries.py`` holds its queries.
"""
