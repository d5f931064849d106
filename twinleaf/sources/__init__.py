"""Readers for tables and files."""

from twinleaf.sources.tables import spread, table

__all__ = ["spread", "table"]
