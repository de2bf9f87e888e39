"""Documents to packed training sequences in five stages; part of ``tidemark.llm``."""

from tidemark.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
