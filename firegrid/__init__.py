"""Wildfire hotspot analytics on gridded satellite scenes, as Spark DataFrame operators."""

from firegrid.schema import GridSpec

__all__ = ["GridSpec"]
