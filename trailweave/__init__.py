"""Object-centric event analytics on Spark DataFrames."""

from .log import Log

__all__ = ["Log"]
