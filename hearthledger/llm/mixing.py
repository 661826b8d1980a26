"""Mixing sources to target weights (operator 2), native: DataFrame and SQL functions only.

Each source gets a token target from its weight; entropy balancing then finds document rates ``r`` that
meet the target while staying as close as possible, in Kullback-Leibler divergence, to one copy each and
never above ``MAX_COPIES``. The solution is an exponential tilt, ``r = min(MAX_COPIES, exp(lambda * x))``
with ``x`` the document's size over its source's mean, one multiplier per source. The convex dual is
solved by safeguarded Newton iterations: every step is one distributed aggregation of value and slope
over the (source, size, count) histogram, so copies and hot sources cost no more than their distinct
sizes, and the multipliers stay in a table.

Rates become copies by systematic rounding in size order: with ``R`` the running sum of rates, a document
gets ``floor(R_d + u) - floor(R_(d-1) + u)``, ``u`` being the one of PHASES starts whose words come nearest
the target. As neighbours in that order have like sizes, a source misses its target by less than a document. Documents of one source and size are numbered within
hashed slices of some ``SLICE`` rows, so that no task gets a hot group whole; a cell of more than one slice
starts each slice at a hashed phase. Rates are rounded to 2**-20 before summing, which keeps sums exact
and reruns equal.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share 150 % of all sizes; no
target passes ``MAX_COPIES`` times its source's size, the excess is shared again by weight (water filling,
closed form over the sources sorted by size over weight).

Defined cases: a null text has size 0; documents of size 0 take nothing; a source without words has target
0; a null source is a source of its own, after all others; repeated rows are separate documents; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable, scratch, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
NEWTON_STEPS = 40
TOLERANCE = 1e-7
SLICE = 256
MAX_SLICES = 4096
PHASES = 32
_ONE = 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(histogram: DataFrame) -> DataFrame:
    """source, source_size, target from (source, size, n); one row per source."""
    total = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*map(F.lit, WEIGHTS))
    weighed = total.withColumn("w", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * MAX_COPIES
    filling = W.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    budget = F.sum("source_size").over(everything) * SHARE
    level = (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # sources are capped while cap / w stays at or below the level that the rest would share
    levelled = weighed.withColumn("level", level).withColumn("capped", cap / F.col("w") <= F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(cap / F.col("w"), F.col("level")))).over(everything)["level"]
    return levelled.withColumn("final", final).select("source", "source_size", "docs", F.when(F.col("final").isNull(), cap).otherwise(F.least(cap.cast("double"), F.col("w") * F.col("final"))).cast("double").alias("target"))


def multipliers(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """source, lam: the multiplier of each source's tilt, null where all documents go to MAX_COPIES."""
    smallest = histogram.filter("size > 0").groupBy(F.col("source").alias("s")).agg(F.min("size").alias("least"))
    mean = F.col("source_size") / F.col("docs")
    state = goals.join(smallest, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "target", mean.alias("mean"),
        (F.log(F.least(F.lit(1.0), F.col("target") / F.col("source_size"))) / (F.col("least") / mean)).alias("lo"),
        (F.log(F.lit(float(MAX_COPIES))) / (F.col("least") / mean)).alias("hi"),
        F.lit(0.0).alias("lam"), (F.col("target") >= F.col("source_size") * MAX_COPIES * (1 - 1e-12)).alias("full"), F.lit(False).alias("done"),
    )
    state = durable(state.withColumn("done", F.col("full")), "mix-state")
    for _ in range(NEWTON_STEPS):
        open_ = state.filter("not done")
        if open_.isEmpty():
            break
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = (F.col("size") * F.col("n")).cast("double")
        cells = histogram.filter("size > 0").join(F.broadcast(open_) if _small(open_) else open_, histogram.source.eqNullSafe(open_.source)).select(open_.source, words.alias("words"), x.alias("x"), tilt.alias("tilt"))
        now = cells.groupBy("source").agg(F.sum(F.col("words") * F.least(F.lit(float(MAX_COPIES)), F.col("tilt"))).alias("f"), F.sum(F.when(F.col("tilt") < MAX_COPIES, F.col("words") * F.col("x") * F.col("tilt")).otherwise(0.0)).alias("g"))
        joined = state.join(now.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        off = F.col("f") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(off, F.col("g"))
        met = F.abs(off) <= TOLERANCE * F.col("target")
        step = F.when(met, F.col("lam")).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        held = F.col("done") | F.col("f").isNull()
        state = durable(
            joined.select("source", "target", "mean", F.when(held, F.col("lo")).otherwise(lo).alias("lo"), F.when(held, F.col("hi")).otherwise(hi).alias("hi"), F.when(held, F.col("lam")).otherwise(step).alias("lam"), "full", F.when(held, True).otherwise(met).alias("done")),
            "mix-state",
        )
    return state.select("source", "mean", F.when(~F.col("full"), F.round("lam", 12)).alias("lam"))


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.count() <= rows


def _phases(cells: DataFrame) -> DataFrame:
    """source, phase: of PHASES starts of the systematic rounding, the one whose words come nearest the target."""
    starts = [(2 * k + 1) * _ONE // (2 * PHASES) for k in range(PHASES)]
    copies = lambda u: F.floor((F.col("before") + F.col("n") * F.col("rate") + u) / _ONE) - F.floor((F.col("before") + u) / _ONE)
    expected = F.col("n") * F.col("rate") / _ONE
    off = [F.abs(F.sum(F.col("size") * (F.when(F.col("slices") > 1, expected).otherwise(copies(u)) - expected))).alias(f"o{k}") for k, u in enumerate(starts)]
    best = F.array_min(F.array(*(F.struct(F.round(f"o{k}", 3).alias("off"), F.lit(u).alias("phase")) for k, u in enumerate(starts))))
    return cells.groupBy("source").agg(*off).select("source", best["phase"].alias("phase"))


def _mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies; one row per document."""
    sized = durable(sizes(docs), "mix-sizes")
    histogram = durable(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    goals = durable(targets(histogram), "mix-targets")
    tilts = multipliers(histogram, goals)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNull(), F.lit(float(MAX_COPIES))).otherwise(F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    g, t = goals.drop("docs").withColumnRenamed("source", "gs"), tilts.withColumnRenamed("source", "ts")
    cells = histogram.join(g, F.col("source").eqNullSafe(F.col("gs"))).join(t, F.col("source").eqNullSafe(F.col("ts")), "left")
    cells = cells.select("source", "size", "n", "source_size", "target", F.round(rate * _ONE).cast("long").alias("rate"))
    running = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(running), F.lit(0)))
    cells = durable(cells.withColumn("slices", F.least(F.lit(MAX_SLICES), F.ceil(F.col("n") / SLICE))), "mix-rates")
    started = _phases(cells).withColumnRenamed("source", "ps")
    cells = cells.join(started, F.col("source").eqNullSafe(F.col("ps"))).withColumn("before", F.col("before") + F.col("phase"))
    cells = durable(cells.select(F.col("source").alias("cs"), F.col("size").alias("cz"), "source_size", "target", "rate", "before", "slices"), "mix-cells")
    joined = sized.join(cells, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz")))
    joined = joined.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("slices")))
    place = F.row_number().over(W.partitionBy("source", "size", "slice").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id"))
    phase = F.when(F.col("slices") > 1, F.pmod(F.xxhash64("source", "size", "slice"), F.lit(_ONE))).otherwise(F.pmod("before", F.lit(_ONE)))
    copies = F.floor((phase + F.col("rate") * place) / _ONE) - F.floor((phase + F.col("rate") * (place - 1)) / _ONE)
    return joined.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies; one row per document."""
    return _mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it (0 to MAX_COPIES times).

    The copies of rows that share a doc_id, null included, are summed by (doc_id, source, size) and spread
    over these rows, so that every source keeps its words. The rows are numbered within hashed slices.
    """
    with scratch(spark):
        mixed = durable(_mixed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "copies"), "mix-copies", keep=True)
    repeated = durable(mixed.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("id")), "mix-repeated")
    # a struct keeps the names of other columns apart from the working ones
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    own = F.col("row.doc_id")
    taken, once, many = mixed, rows, None
    if not repeated.isEmpty():
        rep = F.broadcast(repeated) if _small(repeated, 200_000) else repeated
        taken, once = mixed.join(rep, F.col("doc_id").eqNullSafe(F.col("id")), "left_anti"), rows.join(rep, own.eqNullSafe(F.col("id")), "left_anti")
        many = _spread(rows.join(rep, own.eqNullSafe(F.col("id")), "left_semi"), mixed.join(rep, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"))
    t = taken.select(F.col("doc_id").alias("id"), F.col("copies").cast("int").alias("times"))
    t = F.broadcast(t) if _small(t, 200_000) else t
    out = once.join(t, own.eqNullSafe(F.col("id"))).select("row", "times")
    out = out if many is None else out.unionByName(many)
    return out.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _spread(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """row and ``times``: of rows alike in doc_id, source and size, the place decides which take a copy more."""
    key = ["id", "source", "size"]
    alike = mixed.groupBy(F.col("doc_id").alias("id"), "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    alike = durable(alike.withColumn("slices", F.least(F.lit(MAX_SLICES), F.ceil(F.col("rows") / SLICE))), "mix-alike")
    alike = F.broadcast(alike) if _small(alike) else alike
    size = F.regexp_count(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    placed = rows.select("row", size.alias("words"), F.monotonically_increasing_id().alias("at"))
    placed = placed.join(alike, F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").cast("string").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    placed = durable(placed.withColumn("slice", F.pmod(F.xxhash64("at"), F.col("slices"))), "mix-alike-rows")
    sums = placed.groupBy(*key, "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = durable(sums.select(*(F.col(c).alias(f"{c}2") for c in [*key, "slice"]), before.alias("before")), "mix-alike-slices")
    sums = F.broadcast(sums) if _small(sums) else sums
    placed = placed.withColumn("place", F.row_number().over(W.partitionBy(*key, "slice").orderBy("at")))
    for k, c in enumerate([*key, "slice"]):
        same = F.col(c).eqNullSafe(F.col(f"{c}2"))
        on = same if k == 0 else on & same
    times = F.expr("(copies * (before + place)) div rows - (copies * (before + place - 1)) div rows").cast("int")
    return placed.join(sums, on).select("row", times.alias("times"))
