"""Traces that are still being written, as streams."""
