"""Training-data operators: filtering, deduplication, scoring, mixing and packing of documents.

Each module holds one operator with its own general interface; ``queries`` registers the thin
``opN_<name>`` queries and ``sql`` their DuckDB twins.  Nothing outside this package imports it.
"""
