"""Keyed state over event logs: latest state, ownership, repeats, silence, retention. Every clock is a parameter.

Windows partition by the entity key and order by (time, id); the batch forms are the oracle of the streaming
twins in hearthledger.streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a struct maximum: partial aggregation, no sort and no window."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("_top")
    return rows.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_top.{c}").alias(c) for c in [*order, *rest]))


def accepted_claims(events: DataFrame, key: str, order: list[str], claim: Column, terminal: Column) -> DataFrame:
    """Claims that start work: the first after each terminal event; a claim while owned is a no-op."""
    by = W.partitionBy(key).orderBy(*order)
    run = events.withColumn("_run", F.coalesce(F.sum(F.when(terminal, 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return run.filter(claim).withColumn("_place", F.row_number().over(W.partitionBy(key, "_run").orderBy(*order))).filter("_place = 1").drop("_place", "_run")


def gaps(events: DataFrame, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """gap_us: microseconds since the predecessor of the same key."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("gap_us", us - F.lag(us).over(W.partitionBy(*keys).orderBy(*order)))


def repeats(events: DataFrame, keys: list[str], time: str, order: list[str], seconds: int) -> DataFrame:
    """Events whose predecessor of the same key lies at most ``seconds`` back."""
    return gaps(events, keys, time, order).filter(F.col("gap_us") <= seconds * 1_000_000)


def silent(events: DataFrame, key: str, time: str, as_of: Column, seconds: int) -> DataFrame:
    last = events.groupBy(key).agg(F.max(time).alias("last"))
    return last.filter(F.col("last") < as_of - F.make_dt_interval(secs=F.lit(seconds)))


def sessions(events: DataFrame, key: str, time: str, order: list[str], gap_seconds: int) -> DataFrame:
    """key, session, start, end, n: runs whose gaps stay below ``gap_seconds``."""
    by = W.partitionBy(key).orderBy(*order)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    fresh = F.when(us - F.lag(us).over(by) < gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = events.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(by))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, id_: str, value: str) -> DataFrame:
    """The last ``value`` of ``right`` at or before each row of ``left``: one union, one window, no range join."""
    both = left.select(key, time, id_, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(key, time, id_, F.lit(0).alias("_side"), value))
    by = W.partitionBy(key).orderBy(time, "_side", id_)
    return both.withColumn("as_of", F.last(value, ignorenulls=True).over(by)).filter("_side = 1").drop("_side", value)


def throttled(events: DataFrame, key: str, time: str, id_: str, seconds: int) -> DataFrame:
    """key, time, id: events let through, each at least ``seconds`` after the last one let through.

    An event that follows a gap of ``seconds`` is always let through, so the runs between such gaps are folded one by one.
    """
    fresh = gaps(events.select(key, time, id_), [key], time, [time, id_]).withColumn("_new", F.when(F.col("gap_us") < seconds * 1_000_000, 0).otherwise(1))
    runs = fresh.withColumn("_run", F.sum("_new").over(W.partitionBy(key).orderBy(time, id_)))
    alone = F.struct(F.col(time).alias("t"), F.col(id_).alias("i"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    folded = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(alone)).alias("_e"))
    first = F.struct(F.lit(None).cast("long").alias("last"), F.slice("_e", 1, 0).alias("kept"))

    def step(s: Column, e: Column) -> Column:
        go = s["last"].isNull() | (e["us"] - s["last"] >= seconds * 1_000_000)
        return F.struct(F.when(go, e["us"]).otherwise(s["last"]).alias("last"), F.when(go, F.concat(s["kept"], F.array(e))).otherwise(s["kept"]).alias("kept"))

    return folded.select(key, F.explode(F.aggregate("_e", first, step, lambda s: s["kept"])).alias("_k")).select(key, F.col("_k.t").alias(time), F.col("_k.i").alias(id_))
