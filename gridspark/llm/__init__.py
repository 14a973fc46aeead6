"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. ``registry.queries()`` and ``registry.oracle_sql()`` list its queries.
"""
