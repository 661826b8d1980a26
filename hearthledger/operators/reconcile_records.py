"""Declared against verified: matching by ordered tiers, merging, repairing. All set-based.

A tier's matches are found by equi-joins on a case key and decided by struct minima; later tiers see only what
earlier ones left open. Where a rule reads a list in order, ``ord`` is that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthledger.functions import similarity as M

HOUSEHOLD_TYPES = ("child support", "tanf", "snap", "assistance", "adoption assistance", "foster care")
PERIODS = (12.0, 24.0, 26.0, 52.0, 4.0)
DECIMALS = (10.0, 100.0, 1000.0)


def best_tier(pairs: DataFrame, left: str, tier: Column, order: list[Column], right: str) -> DataFrame:
    """left, right, tier: of each left row's candidates the one of the lowest tier, then the first by ``order``."""
    ranked = pairs.withColumn("_tier", tier).filter("_tier is not null")
    best = F.min(F.struct("_tier", *(c.alias(f"_o{i}") for i, c in enumerate(order)), right)).alias("_b")
    return ranked.groupBy(left).agg(best).select(left, F.col(f"_b.{right}").alias(right), F.col("_b._tier").alias("tier"))


def _named(*names: str) -> Column:
    """The name of a column ``tier`` that counts from 1; null without a tier."""
    out = F.when(F.col("tier") == 1, names[0])
    for k, name in enumerate(names[1:], 2):
        out = out.when(F.col("tier") == k, name)
    return out


def reconcile_income(declared: DataFrame, verified: DataFrame, same_type: Callable[[Column, Column], Column]) -> DataFrame:
    """case, d_id, v_id, how: each declared line with the verified record it describes.

    declared: case, member, d_id, type, annual; verified: case, member, v_id, type, annual. First the member's
    records of the type or of a like figure, a like figure first, then list order. An untyped line left open
    takes the member's only record that no line claims. A line of a household-level type left open takes the
    case's only record of that type if its own member has none.
    """
    d = declared.select("case", "d_id", F.col("member").alias("d_member"), F.col("type").alias("d_type"), F.col("annual").alias("d_annual"))
    v = verified.select("case", "v_id", F.col("member").alias("v_member"), F.col("type").alias("v_type"), F.col("annual").alias("v_annual"))
    both = d.join(v, "case")
    mine, alike = F.col("d_member") == F.col("v_member"), same_type(F.col("d_type"), F.col("v_type"))
    near = F.coalesce(F.abs(F.col("v_annual") - F.col("d_annual")) <= F.greatest(F.lit(1.0), F.abs("d_annual") * 0.02), F.lit(False))
    first = best_tier(both.filter(mine), "d_id", F.when(near, 1).when(alike, 2), [F.col("v_id")], "v_id")
    open_ = d.join(first, "d_id", "left_anti")
    untyped = F.lower(F.coalesce("d_type", F.lit(""))).isin("", "other", "other income")
    free = v.join(first.select("v_id").distinct(), "v_id", "left_anti")
    only = free.groupBy("case", "v_member").agg(F.count("*").alias("n"), F.min("v_id").alias("v_id")).filter("n = 1")
    second = open_.filter(untyped).join(only, (open_["case"] == only["case"]) & (F.col("d_member") == F.col("v_member"))).select("d_id", "v_id").withColumn("tier", F.lit(3))
    level = F.lower("d_type").isin(*HOUSEHOLD_TYPES)
    kinds = open_.filter(level).join(v, "case").filter(alike).groupBy("d_id").agg(F.count("*").alias("n"), F.min("v_id").alias("v_id"), F.bool_or(mine).alias("own"))
    third = kinds.filter("n = 1 and not own").select("d_id", "v_id").withColumn("tier", F.lit(4))
    matched = first.unionByName(second).unionByName(third)
    how = _named("figure", "type", "only unclaimed", "household")
    return d.join(matched, "d_id", "left").select("case", "d_id", "v_id", F.coalesce(how, F.lit("declared_only")).alias("how"))


def reconcile_assets(declared: DataFrame, verified: DataFrame) -> DataFrame:
    """d_id, v_id, how: each declared asset with the verified one it describes.

    case, owner, id, family, number (account), amount. In order: the owner's account of the same last four or one
    slip apart; the owner's record of the family within 1 %; a distinctive amount equal to the cent, whoever owns
    it; the only record of the owner's family when one line declares it. Two different numbers never match.
    """
    d = declared.select("case", "d_id", *(F.col(c).alias(f"d_{c}") for c in ("owner", "family", "number", "amount")))
    v = verified.select("case", "v_id", *(F.col(c).alias(f"v_{c}") for c in ("owner", "family", "number", "amount")))
    alone = d.groupBy("case", "d_owner", "d_family").agg(F.count("*").alias("d_n"))
    only = v.filter("v_amount is not null").groupBy("case", F.col("v_owner").alias("o"), F.col("v_family").alias("f")).agg(F.count("*").alias("v_n"))
    both = d.join(alone, ["case", "d_owner", "d_family"]).join(v, "case").join(only.withColumnRenamed("case", "c"), (F.col("case") == F.col("c")) & (F.col("o") == F.col("v_owner")) & (F.col("f") == F.col("v_family")), "left")
    mine, family = F.col("d_owner") == F.col("v_owner"), F.col("d_family") == F.col("v_family")
    numbers = F.col("d_number").isNotNull() & F.col("v_number").isNotNull()
    same_number = (F.right("d_number", F.lit(4)) == F.right("v_number", F.lit(4))) | M.account_slip(F.col("d_number"), F.col("v_number"))
    equal = F.abs(F.col("d_amount") - F.col("v_amount")) < 0.005
    tier = (
        F.when(mine & numbers & same_number, 1)
        .when(mine & ~numbers & family & M.amounts_close(F.col("d_amount"), F.col("v_amount")), 2)
        .when(F.col("d_number").isNull() & M.distinctive(F.col("d_amount")) & equal, 3)
        .when(mine & ~numbers & family & (F.col("d_n") == 1) & (F.col("v_n") == 1), 4)
    )
    found = best_tier(both, "d_id", tier, [F.when(family, 0).otherwise(1), F.col("v_id")], "v_id")
    how = _named("account", "figure", "to the cent", "only one")
    return d.select("d_id").join(found, "d_id", "left").select("d_id", "v_id", F.coalesce(how, F.lit("declared_only")).alias("how"))


def merged_by_rank(rows: DataFrame, keys: list[str], rank: list[Column], fields: list[str], order: str) -> DataFrame:
    """keys, kept (the ``order`` of the best row), n, fields: the best row's values, gaps filled from the next best; one aggregation."""
    place = F.struct(*rank, F.col(order))
    filled = [F.min_by(F.struct(F.col(f).alias("v")), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    out = rows.groupBy(*keys).agg(F.min(place)[order].alias("kept"), F.count("*").alias("n"), *filled)
    return out.select(*keys, "kept", "n", *(F.col(f"{f}.v").alias(f) for f in fields))


def relation(value: Column, reference: Column, tolerance: float = 0.10) -> Column:
    """How a figure stands to another: same, period (one is the other's share), decimal (a shift), other; with the factor."""
    ratio = F.try_divide(value, reference)
    near = lambda r: F.abs(r - 1) <= tolerance
    found = F.when(near(ratio), F.struct(F.lit("same").alias("kind"), F.lit(1.0).alias("factor")))
    for kind, factors in (("period", PERIODS), ("decimal", DECIMALS)):
        for k in factors:
            found = found.when(near(ratio * k) | near(ratio / k), F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("factor")))
    return F.when(ratio.isNotNull(), found.otherwise(F.struct(F.lit("other").alias("kind"), ratio.alias("factor"))))


def second_declaration(first: Column, second: Column) -> Column:
    """Two documents that state one income: the same figure, its twelfth or twelvefold, or a different one."""
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(b) * 0.02)
    return F.when(near(first, second), "same").when(near(first * 12, second) | near(first, second * 12), "twelve").otherwise("different")


def repaired(value: Column, independent: Column, ceiling: float, tolerance: float) -> Column:
    """An impossible figure divided by 100, 12, 26 or 52, the first that an independent figure corroborates; else as it is."""
    backed = lambda v: F.exists(independent, lambda x: F.abs(v - x) <= tolerance * x)
    out = F.when(value <= ceiling, value)
    for k in (100, 12, 26, 52):
        out = out.when(backed(value / k), value / k)
    return out.otherwise(value)


def claims(rows: DataFrame, keys: list[str], value: str, rank: list[str]) -> DataFrame:
    """keys, value, conflicts: the claim of the highest authority wins; other values are conflicts unless another member holds them."""
    member, field = keys[-2], keys[-1]
    case = keys[:-2]
    win = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(*rank, value)).alias("won"))
    held = win.select(*case, F.col(field), F.col(member).alias("_other"), F.col("won").alias(value))
    losing = rows.filter(F.col(value).isNotNull()).select(*keys, value).distinct().join(win, keys).filter(F.col(value) != F.col("won"))
    foreign = losing.join(held, [*case, field, value]).filter(F.col("_other") != F.col(member)).select(*keys, value).distinct()
    conflicts = losing.join(foreign, [*keys, value], "left_anti").groupBy(*keys).agg(F.count("*").alias("conflicts"))
    return win.join(conflicts, keys, "left").select(*keys, F.col("won").alias(value), F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


def calculation_for(records: DataFrame, calcs: DataFrame) -> DataFrame:
    """r_id, annual, how: a record's calculation: of its member, source and type; else the only one under the payer; else the only one of the type."""
    out, tiers = records, (("exact", ["member", "source", "type"]), ("payer", ["member", "source"]), ("type", ["member", "type"]))
    for name, keys in tiers:
        n = calcs.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by("annual", "c_id").alias(f"_{name}"))
        only = n if name == "exact" else n.filter("_n = 1")
        out = out.join(only.drop("_n"), keys, "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_payer").isNotNull(), "payer").when(F.col("_type").isNotNull(), "type")
    return out.select("r_id", F.coalesce("_exact", "_payer", "_type").alias("annual"), how.alias("how"))


def settled_rents(c: DataFrame) -> DataFrame:
    """gross, tenant, utility, contract, assistance filled in: gross = tenant + utility and contract = tenant + assistance, as far as they determine it."""
    out = c
    for _ in range(2):  # a value found by one identity may open the other
        out = out.select(
            *(x for x in out.columns if x not in ("gross", "tenant", "utility", "contract", "assistance")),
            F.coalesce("gross", F.col("tenant") + F.col("utility")).alias("gross"),
            F.coalesce("tenant", F.col("gross") - F.col("utility"), F.col("contract") - F.col("assistance")).alias("tenant"),
            F.coalesce("utility", F.col("gross") - F.col("tenant")).alias("utility"),
            F.coalesce("contract", F.col("tenant") + F.col("assistance")).alias("contract"),
            F.coalesce("assistance", F.col("contract") - F.col("tenant")).alias("assistance"),
        )
    return out


def rent_basis(gross: Column, tenant: Column, utility: Column, assistance: Column, tolerance: float = 1.0) -> Column:
    """Which identity a printed gross rent obeys: tenant + utility, that with assistance, or none."""
    off = lambda total: F.abs(gross - total) <= tolerance
    return F.when(off(tenant + utility), "tenant+utility").when(off(tenant + utility + assistance), "tenant+utility+assistance").when(off(tenant + assistance), "tenant+assistance").otherwise("none")
