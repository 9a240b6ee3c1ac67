"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import history_queries, ops_queries  # noqa: F401
from ._registry import ORACLE_SQL, QUERIES  # noqa: F401
