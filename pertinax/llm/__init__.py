"""Operators of a large-scale training-data pipeline, one module per operator.

Nothing outside this package imports it.  ``catalog`` registers one query per operator.
"""
