"""Operators of a training-data pipeline over document, page and vector tables.

Nothing else in the library imports this subpackage.
"""
