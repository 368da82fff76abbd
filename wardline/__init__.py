"""Hospital operations analytics as plain PySpark DataFrame functions."""

from wardline.sources.tables import Tables

__all__ = ["Tables"]
