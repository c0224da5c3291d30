"""PySpark operators for the data work around web and document acquisition."""

from gleanery.session import configure, cut_lineage

__all__ = ["configure", "cut_lineage"]
