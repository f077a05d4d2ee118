"""All queries of the library's own operators with their SQL."""

from . import catalog, content, reading, serving, storing  # noqa: F401 - importing registers
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
