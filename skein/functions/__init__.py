"""Scalar functions of traversal steps, as functions of columns."""
