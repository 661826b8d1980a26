"""Confidence: stage scores to field, record and case scores, as group-bys over one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stage weights, thresholds and ceilings. Fixed values.
WEIGHTS = {"extraction": 0.20, "source": 0.30, "cross_doc": 0.15, "business_rule": 0.35, "finding": 0.40}
OTHER_WEIGHT = 0.10
GREEN, YELLOW = 0.80, 0.50
UNVERIFIED_CEILING = 0.79
HEADLINE_WEIGHT = 3.0
COVERAGE_STEP, COVERAGE_FLOOR = 0.08, 0.5


def flag(score: Column) -> Column:
    return F.when(score >= GREEN, "green").when(score >= YELLOW, "yellow").otherwise("red")


def field_scores(stages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, composite, flag: weighted mean of stages, capped by ceilings and, unverified, just below green."""
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("stage")), F.lit(OTHER_WEIGHT))
    seen = F.bool_or(F.col("stage").isin("source", "cross_doc"))
    agg = stages.withColumn("_w", weight).groupBy(*keys).agg(F.sum(F.col("score") * F.col("_w")).alias("s"), F.sum("_w").alias("w"), F.min("ceiling").alias("c"), seen.alias("v"))
    mean = F.col("s") / F.col("w")
    capped = F.least(mean, F.coalesce("c", F.lit(1.0)), F.when(F.col("v"), 1.0).otherwise(UNVERIFIED_CEILING))
    return agg.select(*keys, capped.alias("composite"), flag(capped).alias("flag"))


def coverage(omissions: Column) -> Column:
    return F.greatest(F.lit(COVERAGE_FLOOR), 1 - COVERAGE_STEP * omissions)


def agreement(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, score: two documents and more agree (1.0) or conflict (0.30)."""
    both = values.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(value).alias("kinds")).filter("n >= 2")
    return both.select(*keys, "n", F.when(F.col("kinds") == 1, 1.0).otherwise(0.30).alias("score"))


def precision(verdicts: DataFrame, code: str, valid: str) -> DataFrame:
    """code, n, valid, precision, with one total row; a grouping-sets row, not a second scan."""
    sums = verdicts.rollup(code).agg(F.count("*").alias("n"), F.sum(F.when(F.col(valid), 1).otherwise(0)).alias("valid"), F.grouping(code).alias("_g"))
    return sums.select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col(code)).alias(code), "n", "valid", (F.col("valid") / F.col("n")).alias("precision"))
