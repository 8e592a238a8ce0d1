"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage, so it can be removed whole.
Each operator module has a general interface of its own; ``queries`` binds the
operators to the provided tables.
"""
