"""The five stages in order; each result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing, neardup, packing, pii, quality
from .common import durable, scratch, table

STAGES = [
    ("quality rules", quality.stage),
    ("near-dedup", neardup.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]
#: No SQL: tokenising, expectation-maximisation and best-fit packing have no DuckDB form; tests hold a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # a stage's own tables go when its result is written
            docs = durable(stage(spark, docs, sf_dir), f"pipeline-{k}-{name.replace(' ', '-')}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
