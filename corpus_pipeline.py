"""The stages from raw documents to placed training documents; they are written in textloom.llm.pipeline."""

from textloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
