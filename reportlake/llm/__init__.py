"""Operators for large-scale training-data pipelines.

One module per operator; ``queries.py`` registers the thin ``opN_<name>``
queries. Nothing else in the library imports this subpackage.
"""
