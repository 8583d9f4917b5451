"""Named queries over the Parquet tables of a folder, and DuckDB SQL for the same rows."""

from __future__ import annotations

from lettermill.plans.oracle import ORACLE_SQL
from lettermill.plans.queries import QUERIES

FLAGSHIP = "near_dup_edges"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
