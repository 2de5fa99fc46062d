"""A corpus pipeline over ``documents``: quality rules, near duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from kernelspark.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
