"""Query catalog (named end-to-end queries) and their SQL oracles."""

from .catalog import QUERIES
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
