"""Operators for large text collections: one module per operator.

Nothing else in the package imports this subpackage.
"""
