"""Training-data operators: dedup, quality, mixing, extraction, formatting, counting, decontamination, PII.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries and SQL.
"""
