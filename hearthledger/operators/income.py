"""Annual income from ledgers, pay stubs, year-to-date figures and rates. Clocks are parameters.

All groupings are hash aggregations with map-side partials; windows partition by the source key, whose
groups are one source's dated payments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthledger.functions import normalise as N

#: Yearly ceilings by kind of income, and the age in months at which wages are history. Fixed values.
CEILINGS = {"employment": 300_000.0, "fixed_monthly": 250_000.0, "annual_net": 300_000.0, "other": 300_000.0}
STALE_MONTHS = 15
MAX_HOURLY = 300.0


def period_of_gap(gap: Column) -> Column:
    """Pay period implied by a median gap in days."""
    return (
        F.when(gap.between(5, 9), "weekly").when((gap >= 12) & (gap < 15), "bi-weekly").when(gap.between(15, 18), "semi-monthly")
        .when(gap.between(25, 45), "monthly").when(gap.between(80, 120), "quarterly")
    )


def periodicity(payments: DataFrame, key: str, day: str) -> DataFrame:
    """key, n_dates, gap, period: from the spacing of distinct dates."""
    days = payments.select(key, F.col(day).alias("d")).distinct()
    gaps = days.withColumn("gap", F.datediff("d", F.lag("d").over(W.partitionBy(key).orderBy("d"))))
    return gaps.groupBy(key).agg(F.count("*").alias("n_dates"), F.median("gap").alias("gap")).withColumn("period", period_of_gap(F.col("gap")))


def period_key(day: Column, period: Column) -> Column:
    return (
        F.when(period == "monthly", F.date_format(day, "yyyy-MM"))
        .when(period == "quarterly", F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def annualise_ledger(payments: DataFrame, key: str, day: str, amount: str) -> DataFrame:
    """key, period, buckets, annual, status: a year's sum where a year is covered, a fixed payment times its
    periods, else the mean of period buckets; ``rejected`` with fewer than two payments or no regular period."""
    period = periodicity(payments, key, day)
    dated = payments.select(key, F.col(day).alias("d"), F.col(amount).cast("decimal(18,2)").alias("v"))
    last = dated.groupBy(key).agg(F.max("d").alias("last"), F.min("d").alias("first"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    known = last.join(period.select(key, "period"), key)
    rows = dated.join(known, key)
    buckets = rows.groupBy(key, period_key(F.col("d"), F.col("period")).alias("bucket")).agg(F.sum("v").alias("paid"), F.sum(F.when(F.col("d") > F.date_sub("last", 365), F.col("v"))).alias("recent"))
    whole = buckets.groupBy(key).agg(F.count("*").alias("buckets"), F.sum("paid").alias("paid"), F.sum("recent").alias("recent")).join(known, key)
    per_year = N.multiplier(F.col("period"))
    full = (F.col("buckets") >= per_year) | (F.datediff("last", "first") >= 365 - 2 * 365 / per_year)
    fixed = (F.col("n") >= 4) & (F.col("high") - F.col("low") < 0.01)
    annual = (
        F.when((F.col("n") < 2) | F.col("period").isNull(), F.lit(None).cast("double"))
        .when(full, F.col("recent").cast("double")).when(fixed, F.col("high").cast("double") * per_year)
        .otherwise(F.col("paid").cast("double") / F.col("buckets") * per_year)
    )
    status = F.when((F.col("n") < 2) | F.col("period").isNull(), "rejected").when(full, "full year").when(fixed, "fixed").otherwise("average")
    return whole.select(key, "period", F.when(F.col("period").isNotNull(), F.col("buckets")).alias("buckets"), N.nearest(annual).alias("annual"), status.alias("status"))


def stub_average(stubs: DataFrame, keys: list[str], gross: str, day: str, stated: Column) -> DataFrame:
    """keys, n_stubs, frequency, annual: mean gross times the periods; three or more dates decide over the stated one."""
    days = stubs.select(*keys, F.col(day).alias("d")).distinct()
    gaps = days.withColumn("gap", F.datediff("d", F.lag("d").over(W.partitionBy(*keys).orderBy("d"))))
    dated = gaps.groupBy(*keys).agg(F.count("*").alias("n_dates"), F.median("gap").alias("gap"))
    mean = stubs.groupBy(*keys).agg(F.count(gross).alias("n_stubs"), F.sum(F.col(gross).cast("decimal(18,2)")).cast("double").alias("total"))
    inferred = F.when(F.col("n_dates") >= 3, period_of_gap(F.col("gap")))
    both = mean.join(dated, keys).withColumn("frequency", F.coalesce(inferred, stated))
    return both.select(*keys, "n_stubs", "frequency", N.nearest(F.col("total") / F.col("n_stubs") * N.multiplier(F.col("frequency"))).alias("annual"))


def year_to_date(amount: Column, start: Column, end: Column) -> Column:
    """amount / days * 365, null where the span is empty."""
    days = F.datediff(end, start)
    return F.when(days > 0, amount / days * 365)


def from_rate(rate: Column, unit: Column, hours: Column, frequency: Column) -> Column:
    """Annual pay from a rate: hourly needs hours and a frequency and stays below a cap, others their periods."""
    per = N.multiplier(frequency)
    return (
        F.when((unit == "hourly") & (rate <= MAX_HOURLY), rate * F.coalesce(hours * per, F.lit(2080.0)))
        .when(unit == "per_period", rate * per).otherwise(rate * N.multiplier(unit))
    )


def implausible(annual: Column, kind: Column) -> Column:
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CEILINGS.items() for x in kv)), kind), F.lit(1_000_000.0))
    return F.when(annual > cap, "above ceiling").when((annual < 0) & (kind != "annual_net"), "negative")


def months_between_calendar(earlier: Column, later: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def first_plausible(candidates: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Candidates up to and with the first plausible one, with status: ``rejected`` before it, then ``primary``."""
    good = F.min(F.when(F.col("annual").isNotNull() & F.col("problem").isNull(), F.col(order))).over(W.partitionBy(*keys))
    kept = candidates.withColumn("_first", good).filter(F.col("_first").isNull() | (F.col(order) <= F.col("_first")))
    return kept.withColumn("status", F.when(F.col(order) == F.col("_first"), "primary").otherwise("rejected")).drop("_first")


def repair_sequence(rows: DataFrame, keys: list[str], day: str, total: str) -> DataFrame:
    """Running totals that break the year's rise: over the next one, they fit after a decimal slip of 100 or go."""
    order = W.partitionBy(*keys).orderBy(day)
    before = F.max(total).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(total).over(order.rowsBetween(1, W.unboundedFollowing))
    v = F.col(total)
    slipped = v / 100
    fits = lambda x: (F.coalesce(x >= F.col("_before"), F.lit(True))) & (F.coalesce(x <= F.col("_after"), F.lit(True)))
    marked = rows.withColumn("_before", before).withColumn("_after", after)
    repaired = F.when(v <= F.coalesce(F.col("_after"), v), v).when(fits(slipped), slipped)
    return marked.withColumn("repaired", repaired).drop("_before", "_after")


def newest_per_source(rows: DataFrame, source: str, order: list[Column], n: int = 6) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(source).orderBy(*order))).filter(F.col("place") <= n)
