"""Streaming of the text-vector engine."""
