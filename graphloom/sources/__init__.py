"""Sources and sinks."""

from .tables import table

__all__ = ["table"]
