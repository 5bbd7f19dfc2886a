"""Operators for preparing training text.

Nothing else in the package imports this subpackage; its named queries are in
``queries.py``.
"""
