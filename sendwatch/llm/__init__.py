"""Operators for preparing language-model training data.

Ten operators, one module each, plus the thin queries that apply them to the
driver tables (``queries.py``). Nothing else in the library imports this
subpackage; it imports only ``sendwatch.session`` for lineage cutting.
"""
