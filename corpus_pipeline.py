"""Corpus pipeline: quality rules, near-dedup, PII, mixing, packing. Belongs to hearthledger.llm."""

from hearthledger.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
