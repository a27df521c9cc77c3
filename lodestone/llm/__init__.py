"""Operators for building training corpora from large document tables.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin contract queries live in ``queries.py``.
"""
