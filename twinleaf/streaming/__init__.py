"""Comparison of files as they arrive."""

from twinleaf.streaming.arrivals import compare_arrivals

__all__ = ["compare_arrivals"]
