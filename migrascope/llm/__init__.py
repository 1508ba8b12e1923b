"""Training-data operators: quality, secrets, licences, dedup, PII, ANN, mixing, packing, HTML.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL.
"""
