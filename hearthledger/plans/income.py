"""The income engine bound to orders and lineitem: customers are payers, orders a ledger, lines pay stubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthledger.functions import normalise as N
from hearthledger.operators import income as I
from hearthledger.plans.registry import Tables, query

_GAPS = """days AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders),
gaps AS (SELECT o_custkey, date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap FROM days),
med AS (SELECT o_custkey, count(*) AS n_dates, median(gap) AS gap FROM gaps GROUP BY 1),
per AS (SELECT *, CASE WHEN gap BETWEEN 5 AND 9 THEN 'weekly' WHEN gap >= 12 AND gap < 15 THEN 'bi-weekly' WHEN gap BETWEEN 15 AND 18 THEN 'semi-monthly' WHEN gap BETWEEN 25 AND 45 THEN 'monthly' WHEN gap BETWEEN 80 AND 120 THEN 'quarterly' END AS period FROM med)"""
_TIMES = "CASE period WHEN 'weekly' THEN 52 WHEN 'bi-weekly' THEN 26 WHEN 'semi-monthly' THEN 24 WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 END"
_KEY = "CASE period WHEN 'monthly' THEN strftime(d, '%Y-%m') WHEN 'quarterly' THEN year(d) || '-Q' || quarter(d) ELSE strftime(d, '%Y-%m-%d') END"


def ledger(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")


@query(f"WITH {_GAPS} SELECT * FROM per")
def ledger_periodicity(t: Tables) -> DataFrame:
    """Pay period of each customer's orders from the median gap of distinct dates."""
    return I.periodicity(ledger(t), "o_custkey", "d")


@query(f"""
WITH {_GAPS}, pay AS (SELECT o_custkey, o_orderdate::DATE AS d, o_totalprice::DECIMAL(18,2) AS v FROM orders),
b AS (SELECT o_custkey, {_KEY} AS bucket, sum(v) AS paid FROM pay JOIN per USING (o_custkey) GROUP BY 1, 2),
w AS (SELECT o_custkey, max(d) AS last, min(d) AS first, count(*) AS n, min(v) AS low, max(v) AS high FROM pay GROUP BY 1),
r AS (SELECT o_custkey, sum(v) AS recent FROM pay JOIN w USING (o_custkey) WHERE d > last - 365 GROUP BY 1),
k AS (SELECT o_custkey, count(*) AS buckets, sum(paid) AS paid FROM b GROUP BY 1),
a AS (SELECT *, {_TIMES} AS times FROM k JOIN w USING (o_custkey) JOIN r USING (o_custkey) JOIN per USING (o_custkey)),
s AS (SELECT *, buckets >= times OR date_diff('day', first, last) >= 365 - 2 * 365.0::DOUBLE / times AS whole, n >= 4 AND high - low < 0.01 AS fixed FROM a)
SELECT o_custkey, period, CASE WHEN period IS NOT NULL THEN buckets END AS buckets,
  cents(CASE WHEN n < 2 OR period IS NULL THEN NULL WHEN whole THEN recent::DOUBLE WHEN fixed THEN high::DOUBLE * times ELSE paid::DOUBLE / buckets * times END) AS annual,
  CASE WHEN n < 2 OR period IS NULL THEN 'rejected' WHEN whole THEN 'full year' WHEN fixed THEN 'fixed' ELSE 'average' END AS status
FROM s
""")
def ledger_annualise(t: Tables) -> DataFrame:
    """Annual income from each customer's ledger of orders."""
    return I.annualise_ledger(ledger(t), "o_custkey", "d", "o_totalprice")


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS payments, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS paid FROM orders GROUP BY 1, 2")
def ledger_monthly_buckets(t: Tables) -> DataFrame:
    """Payments by calendar month."""
    month = I.period_key(F.col("d"), F.lit("monthly"))
    return ledger(t).groupBy("o_custkey", month.alias("month")).agg(F.count("*").alias("payments"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("paid"))


_STUBS = "stubs AS (SELECT o_custkey, l_suppkey, l_shipdate::DATE AS d, l_extendedprice::DECIMAL(18,2) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def stubs(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("d"), F.col("l_extendedprice").alias("v"))
    return lines.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").drop("l_orderkey")


@query(f"""
WITH {_STUBS}, days AS (SELECT DISTINCT o_custkey, l_suppkey, d FROM stubs),
gaps AS (SELECT o_custkey, l_suppkey, date_diff('day', lag(d) OVER (PARTITION BY o_custkey, l_suppkey ORDER BY d), d) AS gap FROM days),
med AS (SELECT o_custkey, l_suppkey, count(*) AS n_dates, median(gap) AS gap FROM gaps GROUP BY 1, 2),
tot AS (SELECT o_custkey, l_suppkey, count(*) AS n_stubs, sum(v)::DOUBLE AS total FROM stubs GROUP BY 1, 2),
f AS (SELECT *, coalesce(CASE WHEN n_dates >= 3 THEN CASE WHEN gap BETWEEN 5 AND 9 THEN 'weekly' WHEN gap >= 12 AND gap < 15 THEN 'bi-weekly' WHEN gap BETWEEN 15 AND 18 THEN 'semi-monthly' WHEN gap BETWEEN 25 AND 45 THEN 'monthly' WHEN gap BETWEEN 80 AND 120 THEN 'quarterly' END END, 'monthly') AS period FROM med JOIN tot USING (o_custkey, l_suppkey))
SELECT o_custkey, l_suppkey, n_stubs, period AS frequency, cents(total / n_stubs * {_TIMES}) AS annual FROM f
""")
def paystub_average(t: Tables) -> DataFrame:
    """Annual pay from the average stub; dates decide over the stated monthly interval."""
    return I.stub_average(stubs(t), ["o_custkey", "l_suppkey"], "v", "d", F.lit("monthly"))


@query(f"""
WITH {_STUBS}, y AS (SELECT o_custkey, year(d) AS yr, d, sum(v) AS v FROM stubs GROUP BY 1, 2, 3),
run AS (SELECT o_custkey, yr, d, sum(v) OVER (PARTITION BY o_custkey, yr ORDER BY d) AS ytd FROM y),
last AS (SELECT o_custkey, yr, max(d) AS last, max(ytd)::DOUBLE AS ytd FROM run GROUP BY 1, 2)
SELECT o_custkey, yr, strftime(last, '%Y-%m-%d') AS last, ytd, CASE WHEN date_diff('day', make_date(yr, 1, 1), last) > 0 THEN cents(ytd / date_diff('day', make_date(yr, 1, 1), last) * 365) END AS annual FROM last
""")
def paystub_ytd_projection(t: Tables) -> DataFrame:
    """The newest stub's year-to-date total, projected from the first of January."""
    by_day = stubs(t).groupBy("o_custkey", F.year("d").alias("yr"), "d").agg(F.sum(F.col("v").cast("decimal(18,2)")).alias("v"))
    run = by_day.withColumn("ytd", F.sum("v").over(W.partitionBy("o_custkey", "yr").orderBy("d")))
    last = run.groupBy("o_custkey", "yr").agg(F.max("d").alias("last"), F.max_by("ytd", "d").cast("double").alias("ytd"))
    return last.withColumn("annual", N.nearest(I.year_to_date(F.col("ytd"), F.make_date("yr", F.lit(1), F.lit(1)), F.col("last")))).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@query(f"""
WITH {_STUBS}, y AS (SELECT o_custkey, year(d) AS yr, max(d) AS last, sum(v)::DOUBLE AS ytd, count(*) AS n FROM stubs GROUP BY 1, 2),
c AS (SELECT o_custkey, yr, cents(ytd / date_diff('day', make_date(yr, 1, 1), last) * 365) AS audit, cents(ytd / n * 12) AS stated FROM y WHERE date_diff('day', make_date(yr, 1, 1), last) >= 90)
SELECT o_custkey, yr, stated, audit, frac4(abs(audit - stated) / stated) AS gap FROM c WHERE abs(audit - stated) / stated > 0.25
""")
def ytd_divergence(t: Tables) -> DataFrame:
    """Stub averages that the year-to-date projection contradicts by over a quarter, with 90 days covered."""
    years = stubs(t).groupBy("o_custkey", F.year("d").alias("yr")).agg(F.max("d").alias("last"), F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("ytd"), F.count("*").alias("n"))
    start = F.make_date("yr", F.lit(1), F.lit(1))
    both = years.filter(F.datediff("last", start) >= 90).select("o_custkey", "yr", N.nearest(F.col("ytd") / F.col("n") * 12).alias("stated"), N.nearest(I.year_to_date(F.col("ytd"), start, F.col("last"))).alias("audit"))
    gap = F.abs(F.col("audit") - F.col("stated")) / F.col("stated")
    return both.filter(gap > 0.25).withColumn("gap", N.nearest(gap, 4))


_SLIPS = "slips AS (SELECT o_custkey, year(o_orderdate) AS yr, o_orderkey, o_orderdate, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)::DOUBLE * CASE WHEN o_orderkey % 11 = 0 THEN 100 ELSE 1 END AS ytd FROM orders)"


@query(f"""
WITH {_SLIPS}, w AS (SELECT *, max(ytd) OVER (PARTITION BY o_custkey, yr ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(ytd) OVER (PARTITION BY o_custkey, yr ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM slips)
SELECT o_orderkey, cents(ytd) AS ytd, cents(CASE WHEN ytd <= coalesce(a, ytd) THEN ytd WHEN coalesce(ytd / 100 >= b, TRUE) AND coalesce(ytd / 100 <= a, TRUE) THEN ytd / 100 END) AS repaired FROM w
""")
def ytd_sequence_repair(t: Tables) -> DataFrame:
    """Running totals a hundred times too large are mended where the year's rise proves it, else dropped."""
    order = W.partitionBy("o_custkey", "yr").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.withColumn("yr", F.year("o_orderdate"))
    slip = F.when(F.col("o_orderkey") % 11 == 0, 100).otherwise(1)
    rows = rows.select("o_custkey", "yr", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"), (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(order).cast("double") * slip).alias("ytd"))
    return I.repair_sequence(rows, ["o_custkey", "yr"], "at", "ytd").select("o_orderkey", N.nearest(F.col("ytd")).alias("ytd"), N.nearest(F.col("repaired")).alias("repaired"))


@query("SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber)::INTEGER AS place FROM lineitem) WHERE place <= 6")
def newest_six_per_source(t: Tables) -> DataFrame:
    """The six newest stubs of each payer."""
    return I.newest_per_source(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate"), "l_suppkey", [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]).drop("l_shipdate")


@query("SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last, (2001 - year(max(o_orderdate))) * 12 + 9 - month(max(o_orderdate)) AS months FROM orders GROUP BY 1 HAVING (2001 - year(max(o_orderdate))) * 12 + 9 - month(max(o_orderdate)) > 15")
def stale_evidence(t: Tables) -> DataFrame:
    """Sources whose newest payment is more than fifteen calendar months before September 2001."""
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("last"))
    return last.withColumn("months", I.months_between_calendar(F.col("last"), F.lit("2001-09-01").cast("date")).cast("long")).filter(F.col("months") > I.STALE_MONTHS).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS rate, l_quantity AS hours, CASE l_linenumber % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'per_period' WHEN 2 THEN 'monthly' ELSE 'annually' END AS unit FROM lineitem)
SELECT l_orderkey, l_linenumber, unit, cents(CASE unit WHEN 'hourly' THEN CASE WHEN rate <= 300 THEN rate * hours * 26 END WHEN 'per_period' THEN rate * 26 WHEN 'monthly' THEN rate * 12 ELSE rate END) AS annual FROM r
""")
def rate_based_income(t: Tables) -> DataFrame:
    """Annual pay from a rate by its unit; an hourly rate above the cap is none."""
    unit = F.element_at(F.array(*map(F.lit, ("hourly", "per_period", "monthly", "annually"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    annual = I.from_rate(rate, unit, F.col("l_quantity"), F.lit("bi-weekly"))
    return t.lineitem.select("l_orderkey", "l_linenumber", unit.alias("unit"), N.nearest(F.when((unit == "hourly") & (rate > I.MAX_HOURLY), None).otherwise(annual)).alias("annual"))


@query("""
WITH m AS (SELECT o_custkey, 1 AS ord, 'mean' AS method, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) * 12 AS annual FROM orders GROUP BY 1
  UNION ALL SELECT o_custkey, 2, 'lowest', min(o_totalprice) * 4 FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 3, 'latest', arg_max(o_totalprice, (o_orderdate, o_orderkey)) FROM orders GROUP BY 1),
p AS (SELECT *, CASE WHEN annual > 300000 THEN 'above ceiling' END AS problem FROM m),
f AS (SELECT *, min(CASE WHEN problem IS NULL THEN ord END) OVER (PARTITION BY o_custkey) AS first FROM p)
SELECT o_custkey, ord, method, cents(annual) AS annual, problem, CASE WHEN ord = first THEN 'primary' ELSE 'rejected' END AS status FROM f WHERE first IS NULL OR ord <= first
""")
def all_methods(t: Tables) -> DataFrame:
    """Ordered methods for each source; the first plausible one is primary, none after it is given."""
    orders = t.orders
    v = F.col("o_totalprice")
    one = orders.groupBy("o_custkey").agg((F.sum(v.cast("decimal(18,2)")).cast("double") / F.count("*") * 12).alias("mean"), (F.min(v) * 4).alias("lowest"), F.max_by(v, F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    long = one.select("o_custkey", F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("method"), F.col(n).alias("annual")) for i, n in enumerate(("mean", "lowest", "latest"), 1)))))
    return I.first_plausible(long.withColumn("problem", I.implausible(F.col("annual"), F.lit("employment"))), ["o_custkey"]).withColumn("annual", N.nearest(F.col("annual")))


@query("""
WITH m AS (SELECT o_custkey, cents(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*)) AS mean, cents(median(o_totalprice)) AS mid, cents(arg_max(o_totalprice, (o_orderdate, o_orderkey))) AS latest FROM orders GROUP BY 1)
SELECT o_custkey, mean, mid, latest, frac4((greatest(mean, mid, latest) - least(mean, mid, latest)) / greatest(mean, mid, latest)) AS spread FROM m WHERE (greatest(mean, mid, latest) - least(mean, mid, latest)) / greatest(mean, mid, latest) > 0.1
""")
def methods_disagree(t: Tables) -> DataFrame:
    """Sources whose methods differ by more than a tenth."""
    v = F.col("o_totalprice")
    m = t.orders.groupBy("o_custkey").agg(N.nearest(F.sum(v.cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"), N.nearest(F.median(v)).alias("mid"), N.nearest(F.max_by(v, F.struct("o_orderdate", "o_orderkey"))).alias("latest"))
    top, low = F.greatest("mean", "mid", "latest"), F.least("mean", "mid", "latest")
    return m.filter((top - low) / top > 0.1).withColumn("spread", N.nearest((top - low) / top, 4))


@query("""
WITH m AS (SELECT o_custkey, cents(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*)) AS mean, cents(median(o_totalprice)) AS mid, cents(arg_max(o_totalprice, (o_orderdate, o_orderkey))) AS latest FROM orders GROUP BY 1),
l AS (SELECT o_custkey, unnest(['mean', 'mid', 'latest']) AS method, unnest([mean, mid, latest]) AS v FROM m),
p AS (SELECT a.o_custkey, a.method, a.v, min(abs(a.v - b.v) / greatest(a.v, b.v)) AS nearest FROM l a JOIN l b ON a.o_custkey = b.o_custkey AND a.method <> b.method GROUP BY 1, 2, 3),
c AS (SELECT *, count(*) FILTER (nearest > 0.1) OVER (PARTITION BY o_custkey) AS outs FROM p)
SELECT o_custkey, method, v AS annual, frac4(nearest) AS nearest FROM c WHERE nearest > 0.1 AND outs < 3
""")
def method_outliers(t: Tables) -> DataFrame:
    """A method that lies a tenth off all others, unless all do."""
    v = F.col("o_totalprice")
    m = t.orders.groupBy("o_custkey").agg(N.nearest(F.sum(v.cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"), N.nearest(F.median(v)).alias("mid"), N.nearest(F.max_by(v, F.struct("o_orderdate", "o_orderkey"))).alias("latest"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.greatest(a, b)
    names = ("mean", "mid", "latest")
    rows = F.array(*(F.struct(F.lit(a).alias("method"), F.col(a).alias("annual"), F.least(*(gap(a, b) for b in names if b != a)).alias("nearest")) for a in names))
    outs = F.filter(rows, lambda r: r["nearest"] > 0.1)
    return m.filter((F.size(outs) > 0) & (F.size(outs) < 3)).select("o_custkey", F.inline(outs)).withColumn("nearest", N.nearest(F.col("nearest"), 4))


@query("""
WITH n AS (SELECT o_custkey, o_totalprice AS declared, CASE o_orderkey % 6 WHEN 0 THEN 'weekly' WHEN 1 THEN 'bi-weekly' WHEN 2 THEN 'semi-monthly' WHEN 3 THEN 'monthly' WHEN 4 THEN 'quarterly' ELSE 'annually' END AS f, o_orderkey FROM orders)
SELECT o_orderkey, f AS frequency, cents(declared * CASE f WHEN 'weekly' THEN 52 WHEN 'bi-weekly' THEN 26 WHEN 'semi-monthly' THEN 24 WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 ELSE 1 END) AS annual FROM n
""")
def self_declared(t: Tables) -> DataFrame:
    """A declared amount times the periods of its frequency."""
    f = F.element_at(F.array(*map(F.lit, N.MULTIPLIERS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t.orders.select("o_orderkey", f.alias("frequency"), N.nearest(F.col("o_totalprice") * N.multiplier(f)).alias("annual"))
