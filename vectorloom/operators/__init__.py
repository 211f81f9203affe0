"""Operators of the text-vector engine."""
