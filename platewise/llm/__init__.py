"""Training-data operators: sharding, tokenisation, dedup, filtering, formatting and search.

Nothing else in the library imports this subpackage; its queries are in
:mod:`platewise.llm.queries`.
"""
