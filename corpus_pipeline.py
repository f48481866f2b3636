"""The corpus pipeline of rideframe.llm.pipeline, under the names that its callers look for."""

from rideframe.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, language_id, mixed_sources, near_duplicates, packed, repeated_passages, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "language_id", "mixed_sources", "near_duplicates", "packed", "repeated_passages", "run"]
