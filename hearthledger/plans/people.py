"""Member vocabularies over texts made from customer keys; the oracle lists what each text means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions import people as P
from hearthledger.plans.registry import Tables, query

_SAID = ("White", "5", "15", "Black / African-American", "Asian & White", "Korean; Asian", "Chinese, Korean", "Samoan and white", "prefer not to say", "two or more", "martian", "W")


def _pick(values, key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


@query("""
WITH v(k, o) AS (VALUES (0, 'White'), (1, 'White'), (2, 'American Indian/Alaska Native & White'), (3, 'Black/African American'), (4, 'Asian & White'), (5, 'Asian - Korean'), (6, 'Asian'), (7, 'Other Multi-Racial'), (8, 'Decline to Answer'), (9, 'Other Multi-Racial'), (10, NULL), (11, 'White'))
SELECT c_custkey, o AS race FROM customer JOIN v ON k = c_custkey % 12
""")
def race_fold(t: Tables) -> DataFrame:
    """Ticks, codes and joined labels folded into one category."""
    return t.customer.select("c_custkey", P.race_out(P.races(_pick(_SAID, "c_custkey"))).alias("race"))


@query("""
WITH v(k, o) AS (VALUES (0, 'Hispanic or Latino'), (1, 'Not Hispanic or Latino'), (2, 'Not Hispanic or Latino'), (3, 'Hispanic or Latino'), (4, 'Decline to Answer'), (5, NULL))
SELECT c_custkey, o AS ethnicity FROM customer JOIN v ON k = c_custkey % 6
""")
def ethnicity_out(t: Tables) -> DataFrame:
    """Ethnicity labels and codes; a negation before the name it negates."""
    return t.customer.select("c_custkey", P.ethnicity(_pick(("1", "2", "Non-Hispanic", "Latina", "Chose not to respond", "n/a"), "c_custkey")).alias("ethnicity"))


@query("""
SELECT o_orderkey, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2015-01-01') / 365.25 < 18 AND o_orderkey % 3 < 2 THEN 'Child' WHEN o_orderkey % 3 = 0 THEN 'Spouse' WHEN o_orderkey % 3 = 1 THEN 'Co-Head.' ELSE 'Head' END AS relationship FROM orders
""")
def relationship_by_age(t: Tables) -> DataFrame:
    """Adult roles on minors become Child; the head stays head."""
    role = _pick(("Spouse", "Co-Head.", "Head"), "o_orderkey")
    return t.orders.select("o_orderkey", P.relationship(role, F.col("o_orderdate").cast("date"), F.lit("2015-01-01").cast("date")).alias("relationship"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE CASE l_orderkey % 3 WHEN 0 THEN l_quantity + 5 WHEN 1 THEN l_quantity ELSE l_quantity + 2.5 END END AS hours FROM lineitem
""")
def hours_ranges(t: Tables) -> DataFrame:
    """Hours stated singly or as a range, by the programme's rule."""
    q = F.col("l_quantity").cast("int").cast("string")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.concat(q, F.lit(" hrs"))).otherwise(F.concat(q, F.lit(" to "), (F.col("l_quantity").cast("int") + 5).cast("string")))
    return t.lineitem.select("l_orderkey", "l_linenumber", P.hours(shown, _pick(("highest", "lowest", "average"), "l_orderkey")).alias("hours"))
