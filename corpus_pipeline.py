"""The corpus pipeline's stages (see granary.llm.stages)."""

from __future__ import annotations

from granary.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
