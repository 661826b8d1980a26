"""Declared against verified, bound to orders, their lines and the parts.

A customer is a case; an order is what it declares, the lines of its orders, by return flag, are what documents verify.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions import similarity as M
from hearthledger.functions.normalise import nearest
from hearthledger.operators import linkage as L
from hearthledger.operators import reconcile_records as R
from hearthledger.plans.registry import Tables, query

# lines of an order stand for one verified record for each return flag, a flag for an income type
_VERIFIED = "SELECT o_custkey AS c, o_orderkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS v_id, o_orderkey % 3 AS member, CASE l_returnflag WHEN 'A' THEN 'wage' WHEN 'N' THEN 'pension' ELSE 'child support' END AS type, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS annual FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"
_DECLARED = "SELECT o_custkey AS c, o_orderkey AS d_id, (o_orderkey + length(o_orderpriority)) % 3 AS member, CASE o_orderpriority WHEN '1-URGENT' THEN 'wage' WHEN '2-HIGH' THEN 'pension' WHEN '3-MEDIUM' THEN 'child support' WHEN '5-LOW' THEN 'other' END AS type, o_totalprice AS annual FROM orders"


def _declared(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "wage").when(F.col("o_orderpriority") == "2-HIGH", "pension").when(F.col("o_orderpriority") == "3-MEDIUM", "child support").when(F.col("o_orderpriority") == "5-LOW", "other")
    member = (F.col("o_orderkey") + F.length("o_orderpriority")) % 3
    return t.orders.select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("d_id"), member.alias("member"), kind.alias("type"), F.col("o_totalprice").alias("annual"))


def _verified(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    place = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    kind = F.when(flag == "A", "wage").when(flag == "N", "pension").otherwise("child support")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), place.alias("place"), kind.alias("type"), F.col("l_extendedprice").cast("decimal(18,2)").alias("x"))
    both = t.orders.select("o_orderkey", F.col("o_custkey").alias("case")).join(lines, "o_orderkey")
    return both.groupBy("case", (F.col("o_orderkey") * 4 + F.col("place")).alias("v_id"), (F.col("o_orderkey") % 3).alias("member"), "type").agg(F.sum("x").cast("double").alias("annual"))


@query(f"""
WITH d AS ({_DECLARED}), v AS ({_VERIFIED}),
p AS (SELECT d.d_id, v.v_id, d.member = v.member AS mine, d.type = v.type AS alike, abs(v.annual - d.annual) <= greatest(1.0, abs(d.annual) * 0.02) AS near FROM d JOIN v ON d.c = v.c),
f AS (SELECT d_id, arg_min(v_id, (CASE WHEN near THEN 1 ELSE 2 END, v_id)) AS v_id, min(CASE WHEN near THEN 1 ELSE 2 END) AS tier FROM p WHERE mine AND (near OR alike) GROUP BY 1),
o AS (SELECT * FROM d WHERE d_id NOT IN (SELECT d_id FROM f)),
u AS (SELECT c, member, count(*) AS n, min(v_id) AS v_id FROM v WHERE v_id NOT IN (SELECT v_id FROM f) GROUP BY 1, 2),
s AS (SELECT d_id, u.v_id, 3 AS tier FROM o JOIN u ON o.c = u.c AND o.member = u.member AND n = 1 WHERE coalesce(type, '') IN ('', 'other')),
h AS (SELECT o.d_id, count(*) AS n, min(v.v_id) AS v_id, bool_or(o.member = v.member) AS own FROM o JOIN v ON o.c = v.c AND o.type = v.type WHERE o.type = 'child support' GROUP BY 1),
m AS (SELECT * FROM f UNION ALL SELECT * FROM s UNION ALL SELECT d_id, v_id, 4 FROM h WHERE n = 1 AND NOT own)
SELECT d.c AS "case", d.d_id, m.v_id, coalesce((['figure', 'type', 'only unclaimed', 'household'])[m.tier], 'declared_only') AS how FROM d LEFT JOIN m ON d.d_id = m.d_id
""")
def income_reconciliation(t: Tables) -> DataFrame:
    """Declared incomes with the verified record each describes, by ordered tiers."""
    return R.reconcile_income(_declared(t), _verified(t), lambda a, b: a == b)


@query(f"""
WITH d AS ({_DECLARED}), v AS ({_VERIFIED}),
k AS (SELECT DISTINCT v.v_id FROM d JOIN v ON d.c = v.c AND d.member = v.member AND (d.type = v.type OR abs(v.annual - d.annual) <= greatest(1.0, abs(d.annual) * 0.02)))
SELECT v.c AS "case", count(*) AS verified, count(*) FILTER (v.v_id NOT IN (SELECT v_id FROM k)) AS undeclared FROM v GROUP BY 1
""")
def undeclared_income(t: Tables) -> DataFrame:
    """Verified records that no declared line can describe."""
    d = _declared(t).select("case", "member", F.col("type").alias("d_type"), F.col("annual").alias("d_annual"))
    v = _verified(t)
    near = F.abs(F.col("annual") - F.col("d_annual")) <= F.greatest(F.lit(1.0), F.abs("d_annual") * 0.02)
    known = v.join(d, ["case", "member"]).filter((F.col("type") == F.col("d_type")) | near).select("v_id").distinct().withColumn("known", F.lit(True))
    return v.join(known, "v_id", "left").groupBy("case").agg(F.count("*").alias("verified"), F.count(F.when(F.col("known").isNull(), 1)).alias("undeclared"))


_D_ASSET = "SELECT o_custkey AS c, o_orderkey AS d_id, o_orderpriority AS owner, o_orderstatus AS family, CASE WHEN o_orderkey % 4 = 0 THEN (10000000 + o_orderkey * 37)::VARCHAR END AS number, round(o_totalprice / 10) AS amount FROM orders"
_V_ASSET = "SELECT o_custkey AS c, l_orderkey * 8 + l_linenumber AS v_id, min(o_orderpriority) AS owner, min(CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END) AS family, CASE WHEN l_linenumber = 1 THEN (10000000 + l_orderkey * 37 + l_orderkey % 7)::VARCHAR END AS number, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / 10) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, l_linenumber, l_orderkey"
_SLIP = "(length(d.number) >= 8 AND length(v.number) >= 8 AND levenshtein(d.number, v.number) = 1)"
_DIGIT = "(length(d.amount::DECIMAL(18,2)::VARCHAR) = length(v.amount::DECIMAL(18,2)::VARCHAR) AND left(d.amount::DECIMAL(18,2)::VARCHAR, 1) = left(v.amount::DECIMAL(18,2)::VARCHAR, 1) AND levenshtein(d.amount::DECIMAL(18,2)::VARCHAR, v.amount::DECIMAL(18,2)::VARCHAR) = 1)"


@query(f"""
WITH d AS ({_D_ASSET}), v AS ({_V_ASSET}),
dn AS (SELECT c, owner, family, count(*) AS n FROM d GROUP BY 1, 2, 3), vn AS (SELECT c, owner, family, count(*) AS n FROM v GROUP BY 1, 2, 3),
p AS (SELECT d.d_id, v.v_id, d.family = v.family AS kin, CASE
    WHEN d.owner = v.owner AND d.number IS NOT NULL AND v.number IS NOT NULL AND (right(d.number, 4) = right(v.number, 4) OR {_SLIP}) THEN 1
    WHEN d.owner = v.owner AND (d.number IS NULL OR v.number IS NULL) AND d.family = v.family AND (abs(d.amount - v.amount) <= greatest(0.02, abs(v.amount) * 0.01) OR {_DIGIT}) THEN 2
    WHEN d.number IS NULL AND d.amount > 0 AND d.amount % 50 <> 0 AND abs(d.amount - v.amount) < 0.005 THEN 3
    WHEN d.owner = v.owner AND (d.number IS NULL OR v.number IS NULL) AND d.family = v.family AND dn.n = 1 AND vn.n = 1 THEN 4 END AS tier
  FROM d JOIN v ON d.c = v.c JOIN dn ON dn.c = d.c AND dn.owner = d.owner AND dn.family = d.family JOIN vn ON vn.c = v.c AND vn.owner = v.owner AND vn.family = v.family),
b AS (SELECT d_id, arg_min(v_id, (tier, CASE WHEN kin THEN 0 ELSE 1 END, v_id)) AS v_id, min(tier) AS tier FROM p WHERE tier IS NOT NULL GROUP BY 1)
SELECT d.d_id, b.v_id, coalesce((['account', 'figure', 'to the cent', 'only one'])[b.tier], 'declared_only') AS how FROM d LEFT JOIN b USING (d_id)
""")
def asset_reconciliation(t: Tables) -> DataFrame:
    """Declared assets with the verified one each describes: account, figure, cent-exact, only one of its kind."""
    d = t.orders.select(
        F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("d_id"), F.col("o_orderpriority").alias("owner"), F.col("o_orderstatus").alias("family"),
        F.when(F.col("o_orderkey") % 4 == 0, (10_000_000 + F.col("o_orderkey") * 37).cast("string")).alias("number"), F.round(F.col("o_totalprice") / 10).alias("amount"),
    )
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("x")).join(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    family = F.min(F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O").otherwise("P"))
    v = lines.groupBy("o_custkey", "o_orderkey", "l_linenumber").agg(F.min("o_orderpriority").alias("owner"), family.alias("family"), F.round(F.sum("x").cast("double") / 10).alias("amount"))
    number = F.when(F.col("l_linenumber") == 1, (10_000_000 + F.col("o_orderkey") * 37 + F.col("o_orderkey") % 7).cast("string"))
    v = v.select(F.col("o_custkey").alias("case"), (F.col("o_orderkey") * 8 + F.col("l_linenumber")).alias("v_id"), "owner", "family", number.alias("number"), "amount")
    return R.reconcile_assets(d, v)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM orders)
SELECT o_custkey, o_orderpriority, min(o_orderkey) FILTER (place = 1) AS kept, count(*) AS n, min(o_totalprice) FILTER (place = 1) AS o_totalprice, strftime(min(o_orderdate) FILTER (place = 1), '%Y-%m-%d') AS o_orderdate FROM r GROUP BY 1, 2
""")
def resolved_declarations(t: Tables) -> DataFrame:
    """Several declarations of one source: the best by evidence (status), amount and order; its gaps filled from the next."""
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return R.merged_by_rank(rows, ["o_custkey", "o_orderpriority"], [F.col("o_orderstatus"), -F.col("o_totalprice")], ["o_totalprice", "o_orderdate"], "o_orderkey")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders),
k AS (SELECT o_custkey, o_orderpriority, o_totalprice AS first FROM r WHERE place = 1)
SELECT o_orderkey, CASE WHEN abs(first - o_totalprice) <= greatest(1.0, abs(o_totalprice) * 0.02) THEN 'same' WHEN abs(first * 12 - o_totalprice) <= greatest(1.0, abs(o_totalprice) * 0.02) OR abs(first - o_totalprice * 12) <= greatest(1.0, abs(o_totalprice * 12) * 0.02) THEN 'twelve' ELSE 'different' END AS kind
FROM r JOIN k USING (o_custkey, o_orderpriority) WHERE place > 1
""")
def collapsed_declarations(t: Tables) -> DataFrame:
    """A second document that states an income: the first one's figure, its twelfth or twelvefold, or another."""
    first = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("f"))
    rest = t.orders.join(first, ["o_custkey", "o_orderpriority"]).filter(F.col("o_orderkey") != F.col("f.o_orderkey"))
    return rest.select("o_orderkey", R.second_declaration(F.col("f.o_totalprice"), F.col("o_totalprice")).alias("kind"))


@query("""
WITH s AS (SELECT l_orderkey, list(l_extendedprice) AS x FROM lineitem GROUP BY 1), v AS (SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 12 END AS v, coalesce(x, []) AS x FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, cents(CASE WHEN v <= 300000 THEN v WHEN len(list_filter(x, lambda y: abs(v / 100 - y) <= 0.2 * y)) > 0 THEN v / 100 WHEN len(list_filter(x, lambda y: abs(v / 12 - y) <= 0.2 * y)) > 0 THEN v / 12
  WHEN len(list_filter(x, lambda y: abs(v / 26 - y) <= 0.2 * y)) > 0 THEN v / 26 WHEN len(list_filter(x, lambda y: abs(v / 52 - y) <= 0.2 * y)) > 0 THEN v / 52 ELSE v END) AS annual FROM v
""")
def repaired_magnitudes(t: Tables) -> DataFrame:
    """Impossible annual figures scaled back where a verified figure (a line) corroborates it."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_extendedprice").alias("x"))
    v = F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 100).otherwise(12)
    both = t.orders.select("o_orderkey", v.alias("v")).join(s, "o_orderkey", "left").withColumn("x", F.coalesce("x", F.array().cast("array<double>")))
    return both.select("o_orderkey", nearest(R.repaired(F.col("v"), F.col("x"), 300_000, 0.2)).alias("annual"))


@query("""
WITH c AS (SELECT l_suppkey % 20 AS hh, l_suppkey AS member, l_returnflag AS field, l_linestatus || (l_quantity::INT % 5)::VARCHAR AS value, l_linenumber AS authority, l_orderkey AS page FROM lineitem),
w AS (SELECT hh, member, field, arg_min(value, (authority, page, value)) AS won FROM c GROUP BY 1, 2, 3),
l AS (SELECT DISTINCT c.hh, c.member, c.field, c.value FROM c JOIN w USING (hh, member, field) WHERE value <> won),
x AS (SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.hh = l.hh AND w.field = l.field AND w.won = l.value AND w.member <> l.member))
SELECT w.hh, w.member, w.field, w.won AS value, count(x.value) AS conflicts FROM w LEFT JOIN x USING (hh, member, field) GROUP BY 1, 2, 3, 4
""")
def identity_claims(t: Tables) -> DataFrame:
    """What documents claim of a member's fields: the highest authority wins, the rest conflict unless another member of the household holds it."""
    value = F.concat(F.col("l_linestatus"), (F.col("l_quantity").cast("int") % 5).cast("string"))
    rows = t.lineitem.select((F.col("l_suppkey") % 20).alias("hh"), F.col("l_suppkey").alias("member"), F.col("l_returnflag").alias("field"), value.alias("value"), F.col("l_linenumber").alias("authority"), F.col("l_orderkey").alias("page"))
    return R.claims(rows, ["hh", "member", "field"], "value", ["authority", "page"])


@query("""
WITH c AS (SELECT l_suppkey AS member, l_returnflag AS source, l_linestatus || (l_partkey % 2)::VARCHAR AS type, min(l_extendedprice) AS annual, min(l_orderkey) AS c_id FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 7 = l_suppkey % 7 GROUP BY 1, 2, 3),
e AS (SELECT member, source, type, arg_min(annual, c_id) AS a FROM c GROUP BY 1, 2, 3), p AS (SELECT member, source, min(annual) AS a FROM c GROUP BY 1, 2 HAVING count(*) = 1), y AS (SELECT member, type, min(annual) AS a FROM c GROUP BY 1, 2 HAVING count(*) = 1),
k AS (SELECT l_orderkey AS r_id, l_suppkey AS member, l_returnflag AS source, l_linestatus || (l_partkey % 3)::VARCHAR AS type FROM lineitem WHERE l_linenumber = 4)
SELECT r_id, coalesce(e.a, p.a, y.a) AS annual, CASE WHEN e.a IS NOT NULL THEN 'exact' WHEN p.a IS NOT NULL THEN 'payer' WHEN y.a IS NOT NULL THEN 'type' END AS how FROM k LEFT JOIN e USING (member, source, type) LEFT JOIN p USING (member, source) LEFT JOIN y USING (member, type)
""")
def record_calculations(t: Tables) -> DataFrame:
    """A record's calculation: exact, else the only one under the payer, else the only one of the type."""
    kind = lambda k: F.concat(F.col("l_linestatus"), (F.col("l_partkey") % k).cast("string")).alias("type")
    who = (F.col("l_suppkey").alias("member"), F.col("l_returnflag").alias("source"))
    calcs = t.lineitem.filter("l_linenumber <= 3 and l_orderkey % 7 = l_suppkey % 7").select(*who, kind(2), "l_extendedprice", "l_orderkey")
    calcs = calcs.groupBy("member", "source", "type").agg(F.min("l_extendedprice").alias("annual"), F.min("l_orderkey").alias("c_id"))
    return R.calculation_for(t.lineitem.filter("l_linenumber = 4").select(F.col("l_orderkey").alias("r_id"), *who, kind(3)), calcs)


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity + l_suppkey END AS gross, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS tenant, CASE WHEN l_partkey % 7 <> 0 THEN l_suppkey::DOUBLE END AS utility, CASE WHEN l_partkey % 2 = 0 THEN l_quantity + l_linenumber END AS contract, CASE WHEN l_partkey % 11 <> 0 THEN l_linenumber::DOUBLE END AS assistance FROM lineitem),
a AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(gross, tenant + utility) AS gross, coalesce(tenant, gross - utility, contract - assistance) AS tenant, coalesce(utility, gross - tenant) AS utility, coalesce(contract, tenant + assistance) AS contract, coalesce(assistance, contract - tenant) AS assistance FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(gross, tenant + utility) AS gross, coalesce(tenant, gross - utility, contract - assistance) AS tenant, coalesce(utility, gross - tenant) AS utility, coalesce(contract, tenant + assistance) AS contract, coalesce(assistance, contract - tenant) AS assistance FROM a
""")
def settled_rents(t: Tables) -> DataFrame:
    """Open rent fields filled from the identities between them."""
    x = lambda keep, value, name: F.when(keep, value.cast("double")).alias(name)
    p, q, s, n = F.col("l_partkey"), F.col("l_quantity"), F.col("l_suppkey"), F.col("l_linenumber")
    c = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", x(p % 5 != 0, q + s, "gross"), x(p % 3 != 0, q, "tenant"), x(p % 7 != 0, s, "utility"), x(p % 2 == 0, q + n, "contract"), x(p % 11 != 0, n, "assistance"))
    return R.settled_rents(c)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_quantity - (l_linenumber + l_suppkey % 10)) <= 1 THEN 'tenant+utility' WHEN abs(l_quantity - (l_linenumber + l_suppkey % 10 + l_partkey % 20)) <= 1 THEN 'tenant+utility+assistance' WHEN abs(l_quantity - (l_linenumber + l_partkey % 20)) <= 1 THEN 'tenant+assistance' ELSE 'none' END AS basis FROM lineitem
""")
def gross_rent_basis(t: Tables) -> DataFrame:
    """Which identity a printed gross rent obeys."""
    basis = R.rent_basis(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey") % 10, F.col("l_partkey") % 20)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", basis.alias("basis"))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, v / o_totalprice AS x FROM orders JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, kind, factor FROM (SELECT o_orderkey, CASE WHEN abs(x - 1) <= 0.1 THEN 'same'
  WHEN list_contains(list_transform([12.0, 24.0, 26.0, 52.0, 4.0], lambda k: abs(x * k - 1) <= 0.1 OR abs(x / k - 1) <= 0.1), true) THEN 'period'
  WHEN list_contains(list_transform([10.0, 100.0, 1000.0], lambda k: abs(x * k - 1) <= 0.1 OR abs(x / k - 1) <= 0.1), true) THEN 'decimal' ELSE 'other' END AS kind,
  CASE WHEN abs(x - 1) <= 0.1 THEN 1.0 WHEN list_contains(list_transform([12.0, 24.0, 26.0, 52.0, 4.0, 10.0, 100.0, 1000.0], lambda k: abs(x * k - 1) <= 0.1 OR abs(x / k - 1) <= 0.1), true)
  THEN list_filter([12.0, 24.0, 26.0, 52.0, 4.0, 10.0, 100.0, 1000.0], lambda k: abs(x * k - 1) <= 0.1 OR abs(x / k - 1) <= 0.1)[1] ELSE frac4(x) END::DOUBLE AS factor FROM r)
""")
def figure_relations(t: Tables) -> DataFrame:
    """How the sum of an order's lines stands to its declared total."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"))
    found = t.orders.select("o_orderkey", "o_totalprice").join(s, "o_orderkey").withColumn("r", R.relation(F.col("v"), F.col("o_totalprice")))
    return found.select("o_orderkey", "r.kind", F.when(F.col("r.kind") == "other", nearest(F.col("r.factor"), 4)).otherwise(F.col("r.factor")).alias("factor"))


_PRICES = "p AS (SELECT a.p_partkey AS x, b.p_partkey AS y, a.p_retailprice + a.p_partkey % 7 AS d, b.p_retailprice AS v FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey)"


@query(f"""
WITH {_PRICES} SELECT x, y, abs(d - v) <= greatest(1.0, abs(v) * 0.02) AS near, (abs(d - v) <= greatest(0.02, abs(v) * 0.01) OR {_DIGIT.replace('d.amount', 'd').replace('v.amount', 'v')}) AS close, abs(d - v) < 0.005 AS equal, (d > 0 AND (round(d * 100)::BIGINT % 100 <> 0 OR d % 50 <> 0)) AS distinctive FROM p
""")
def amount_tolerances(t: Tables) -> DataFrame:
    """The tolerances by which amounts count as one: near, close, equal, and whether an amount is distinctive. Rules read a pair of amounts once, whatever the number of parts at them."""
    rows = t.part.select("p_brand", "p_size", "p_partkey", (F.col("p_retailprice") + F.col("p_partkey") % 7).alias("d"), F.col("p_retailprice").alias("v"))
    a, b = (L.classes(rows, ["p_brand", "p_size", c], "p_partkey", f"ids_{c}") for c in ("d", "v"))
    d, v = F.col("d"), F.col("v")
    rules = (F.abs(d - v) <= F.greatest(F.lit(1.0), F.abs(v) * 0.02)).alias("near"), M.amounts_close(d, v).alias("close"), (F.abs(d - v) < 0.005).alias("equal"), M.distinctive(d).alias("distinctive")
    ruled = a.join(b, ["p_brand", "p_size"]).select("ids_d", "ids_v", *rules)
    return L.each_pair(ruled, "ids_d", "ids_v", "x", "y").filter("x <> y").select("x", "y", "near", "close", "equal", "distinctive")


@query("""
WITH n AS (SELECT s_suppkey AS k, (10000000 + s_suppkey * 13)::VARCHAR AS t FROM supplier UNION ALL SELECT 1000000 + p_partkey, CASE WHEN p_partkey % 2 = 0 THEN substr((10000000 + p_partkey * 13)::VARCHAR, 1, 5) || '4' || substr((10000000 + p_partkey * 13)::VARCHAR, 6) ELSE (10000000 + p_partkey * 13)::VARCHAR END FROM part)
SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON a.k < b.k AND abs(length(a.t) - length(b.t)) <= 1 AND levenshtein(a.t, b.t) = 1
""")
def account_slips(t: Tables) -> DataFrame:
    """Account numbers one digit substituted, dropped or added apart."""
    other = (10_000_000 + F.col("p_partkey") * 13).cast("string")
    split = F.concat(F.substring(other, 1, 5), F.lit("4"), F.substring(other, 6, 20))
    parts = t.part.select((1_000_000 + F.col("p_partkey")).alias("k"), F.when(F.col("p_partkey") % 2 == 0, split).otherwise(other).alias("t"))
    return L.slip_pairs(t.supplier.select(F.col("s_suppkey").alias("k"), (10_000_000 + F.col("s_suppkey") * 13).cast("string").alias("t")).union(parts), "k", "t")


@query("""
WITH n AS (SELECT p_partkey AS k, p_brand, split_part(p_name, ' ', 1) || ' ' || lower(p_type) || CASE WHEN p_size % 3 = 0 THEN '-' || split_part(p_name, ' ', 2) ELSE '' END AS name FROM part),
w AS (SELECT k, p_brand, regexp_split_to_array(name, '[ \t-]+') AS w FROM n)
SELECT a.k AS a, b.k AS b FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.k < b.k WHERE (starts_with(a.w[1], b.w[1]) OR starts_with(b.w[1], a.w[1]))
  AND ((a.w[-1] = b.w[-1] OR (length(a.w[-1]) >= 4 AND length(b.w[-1]) >= 4 AND levenshtein(a.w[-1], b.w[-1]) <= 1)) OR (len(a.w) <> len(b.w) AND len(list_filter(range(2, least(len(a.w), len(b.w)) + 1), lambda i: NOT (a.w[i] = b.w[i] OR (length(a.w[i]) >= 4 AND length(b.w[i]) >= 4 AND levenshtein(a.w[i], b.w[i]) <= 1)))) = 0))
""")
def same_members(t: Tables) -> DataFrame:
    """Names of one person within a brand: given names agree, surnames read as one. Blocked by the given name's first letter; two names are compared once, whatever the number of parts that hold them."""
    given = F.split("p_name", " ")
    name = F.concat(given[0], F.lit(" "), F.lower("p_type"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("-"), given[1])).otherwise(""))
    n = t.part.select("p_brand", name.alias("name"), F.substring(F.lower(F.trim(name)), 1, 1).alias("block"), "p_partkey")
    held = lambda k: L.classes(n, ["p_brand", "block", "name"], "p_partkey", f"ids_{k}").withColumnRenamed("name", f"n{k}")
    names = n.select("p_brand", "block", F.col("name").alias("na")).distinct()
    alike = names.join(names.withColumnRenamed("na", "nb"), ["p_brand", "block"]).filter("na <= nb").filter(M.same_member(F.col("na"), F.col("nb")))
    pairs = alike.join(held("a"), ["p_brand", "block", "na"]).join(held("b"), ["p_brand", "block", "nb"]).select((F.col("na") == F.col("nb")).alias("same"), "ids_a", "ids_b")
    return L.each_pair(pairs, "ids_a", "ids_b", "a", "b").filter("not same or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query("""
WITH w AS (SELECT p_partkey, p_brand, p_size, list_distinct(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS w FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE list_has_any(a.w, b.w)
""")
def source_overlaps(t: Tables) -> DataFrame:
    """Payers that share a word that says something: an equi-join on the word, not all pairs."""
    words = t.part.select("p_partkey", "p_brand", "p_size", F.explode(M.source_words(F.col("p_name"))).alias("w"))
    other = words.withColumnsRenamed({"p_partkey": "b"})
    return words.withColumnsRenamed({"p_partkey": "a"}).join(other, ["p_brand", "p_size", "w"]).filter("a < b").select("a", "b").distinct()


@query("""
WITH h AS (SELECT p_brand, list_distinct(list(p_name)) AS names FROM part WHERE p_size <= 3 GROUP BY 1)
SELECT p_partkey, len(list_filter(names, lambda n: contains(n, p_name) OR contains(p_name, n) OR len(list_filter(string_split(p_name, ' '), lambda w: list_contains(string_split(n, ' '), w)))::DOUBLE / len(string_split(p_name, ' ')) >= 0.5)) > 0 AS known FROM part JOIN h USING (p_brand)
""")
def names_in_household(t: Tables) -> DataFrame:
    """Whether a name is one of the household's: contained either way or half of its words. A household's names are few."""
    h = t.part.filter("p_size <= 3").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"))
    return t.part.join(h, "p_brand").select("p_partkey", M.name_in(F.col("p_name"), F.col("names")).alias("known"))


@query("""
WITH RECURSIVE w AS (SELECT p_partkey, p_brand, p_type, unnest(list_distinct(regexp_extract_all(lower(p_name), '[a-z]{3,}'))) AS w FROM part),
e AS (SELECT DISTINCT a.p_partkey AS x, b.p_partkey AS y FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.w = b.w AND a.p_partkey <> b.p_partkey),
r(p, root) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.p WHERE r.root < e.y),
m AS (SELECT p, min(root) AS kept FROM r GROUP BY 1)
SELECT kept, count(*) AS n, max(p_retailprice) AS price, min(p_size) AS size FROM m JOIN part ON p_partkey = p GROUP BY 1
""")
def merged_sources(t: Tables) -> DataFrame:
    """Records of one member and type that share a payer word, by any chain, merged into the first."""
    from hearthledger.sources.session import written

    rows = t.part.select("p_partkey", "p_brand", "p_type", "p_retailprice", "p_size", M.source_words(F.col("p_name")).alias("w"))
    words = rows.select("p_partkey", "p_brand", "p_type", F.explode("w").alias("w"))
    ties = words.join(words.groupBy("p_brand", "p_type", "w").agg(F.min("p_partkey").alias("b")), ["p_brand", "p_type", "w"]).select(F.col("p_partkey").alias("a"), "b").filter("a <> b")
    found = L.clusters(ties, rows, "p_partkey", written)
    return found.join(rows, "p_partkey").groupBy(F.col("cluster").alias("kept")).agg(F.count("*").alias("n"), F.max("p_retailprice").alias("price"), F.min("p_size").alias("size"))


@query("""
WITH a AS (SELECT o_custkey, o_orderkey, o_orderpriority AS kind, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS v, o_orderdate FROM orders)
SELECT o_custkey, kind, arg_min(v, (-epoch_us(o_orderdate), o_orderkey)) FILTER (v IS NOT NULL) AS value, count(*) AS documents FROM a GROUP BY 1, 2
""")
def newest_supplement(t: Tables) -> DataFrame:
    """A field from the newest document that states it."""
    v = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    newest = F.max(F.when(v.isNotNull(), F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k"), v.alias("v"))))
    return t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("kind")).agg(newest["v"].alias("value"), F.count("*").alias("documents"))
