"""A training corpus from documents; the stages and what they promise are in parley.llm.pipeline."""

from parley.llm.pipeline import ORACLE_SQL, run, STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]
