"""Labels by a broadcast dimension, runs of equal labels, packet order, checklist rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical(rows: DataFrame, label: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with label and fit (exact, alias, none): suffixes in brackets set apart, a bounded dimension broadcast."""
    base = F.lower(F.trim(F.regexp_replace(label, r"\s*\((Previous|Superseded)\)$", "")))
    hit = rows.withColumn("_l", base).join(F.broadcast(aliases), F.col("_l") == F.col("alias"), "left")
    fit = F.when(F.col("canonical").isNull(), "none").when(F.lower("canonical") == F.col("_l"), "exact").otherwise("alias")
    return hit.withColumn("fit", fit).drop("_l", "alias")


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern found: an ordered CASE."""
    case = F.when(F.lit(False), other)
    for pattern, label in rules:
        case = case.when(text.rlike(pattern), label)
    return case.otherwise(other)


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, run, value, first, last, n: maximal runs of equal values (gaps and islands)."""
    by = W.partitionBy(key).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(by)) & F.lag(order).over(by).isNotNull(), 0).otherwise(1)
    numbered = rows.select(key, order, value, change.alias("_c")).withColumn("run", F.sum("_c").over(by))
    return numbered.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def by_shared_words(asked: DataFrame, id_: str, words: str, labels: DataFrame) -> DataFrame:
    """Each row's label by the share of the label's words it holds (half at least); ties to the longer, then first name.

    Words are an equi-join, so only labels that share one are scored."""
    long = asked.select(id_, F.explode(F.array_distinct(words)).alias("w"))
    names = labels.select("label", F.size(F.array_distinct("words")).alias("size"), F.explode(F.array_distinct("words")).alias("w"))
    hits = long.join(F.broadcast(names), "w").groupBy(id_, "label", "size").agg(F.count("*").alias("k")).filter(F.col("k") * 2 >= F.col("size"))
    best = F.min_by("label", F.struct((-F.col("k") / F.col("size")).alias("s"), (-F.col("size")).alias("z"), F.col("label")))
    return hits.groupBy(id_).agg(best.alias("label"))
