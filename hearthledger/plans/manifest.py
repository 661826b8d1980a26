"""Manifest linking, repeated records and payloads bound to parts, orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.normalise import nearest
from hearthledger.operators import manifest as O
from hearthledger.plans.registry import Tables, query
from hearthledger.sources.session import written


@query(None)
def member_links(t: Tables) -> DataFrame:
    """Members (small parts) linked to held rows (large parts) of a brand by date (type) and name; greedy, so tests hold it to a plain loop."""
    person = lambda df, k: df.select(F.col("p_brand").alias("case"), F.col("p_partkey").alias(k), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("dob"))
    links = O.member_links(person(t.part.filter("p_size <= 25"), "i"), person(t.part.filter("p_size > 25"), "j"), written)
    return links.select("i", "j", "tier", nearest(F.col("score"), 4).alias("score"))


@query(None)
def record_links(t: Tables) -> DataFrame:
    """Records linked to held ones of the member and type, by source name where there are several; greedy, tested against a plain loop."""
    record = lambda df, k: df.select(F.col("p_brand").alias("member"), F.col("p_type").alias("type"), F.col("p_partkey").alias(k), F.col("p_name").alias("source"))
    links = O.record_links(record(t.part.filter("p_size <= 25"), "i"), record(t.part.filter("p_size > 25"), "j"), written)
    return links.select("i", "j", nearest(F.col("score"), 4).alias("score"))


@query("""
WITH n AS (SELECT *, CASE WHEN o_totalprice - lag(o_totalprice) OVER w <= greatest(1.0, o_totalprice * 0.02) THEN 0 ELSE 1 END AS fresh FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT o_orderkey, arg_min(o_orderkey, (o_orderstatus, o_orderkey)) OVER (PARTITION BY o_custkey, g) AS kept FROM g
""".replace("arg_min(o_orderkey, (o_orderstatus, o_orderkey)) OVER (PARTITION BY o_custkey, g)", "first_value(o_orderkey) OVER (PARTITION BY o_custkey, g ORDER BY o_orderstatus, o_orderkey)"))
def benefit_groups(t: Tables) -> DataFrame:
    """Statements of one benefit by several documents, and the one that is kept."""
    return O.benefit_groups(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", ["o_orderstatus"])


@query("""
SELECT p_brand, p_type || p_size AS dob, count(*) AS members FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_name) > 1
""")
def possible_duplicate_members(t: Tables) -> DataFrame:
    """Members of different names with one birth date (type and size)."""
    rows = t.part.select("p_brand", "p_partkey", "p_name", F.concat("p_type", F.col("p_size").cast("string")).alias("dob"))
    return O.shared_identity(rows, "p_brand", "p_partkey", "p_name", "dob")


@query("""
WITH s AS (SELECT l_orderkey, l_returnflag, floor(l_extendedprice / 1000)::BIGINT::VARCHAR AS amount, floor(o_totalprice / 1000)::BIGINT::VARCHAR AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT DISTINCT l_orderkey, amount FROM s WHERE amount = total OR EXISTS (SELECT 1 FROM s k WHERE k.l_orderkey = s.l_orderkey AND k.l_returnflag <> s.l_returnflag AND k.amount = s.amount)
""")
def stub_amount_suspects(t: Tables) -> DataFrame:
    """Pay-stub amounts, printed in thousands, that repeat a figure known from elsewhere in the case."""
    shown = lambda c: F.floor(F.col(c) / 1000).cast("string").alias("amount")
    stubs = t.lineitem.select("l_orderkey", "l_returnflag", shown("l_extendedprice")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    totals = stubs.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), shown("o_totalprice")), ["l_orderkey", "amount"], "left_semi")
    several = stubs.groupBy("l_orderkey", "amount").agg(F.countDistinct("l_returnflag").alias("k")).filter("k > 1")
    return totals.select("l_orderkey", "amount").union(several.select("l_orderkey", "amount")).distinct()


@query("""
SELECT o_custkey, p_name AS source, count(DISTINCT l_suppkey) AS records FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1
""")
def duplicate_employers(t: Tables) -> DataFrame:
    """One employer's name on several records of a member."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.col("l_partkey").alias("p_partkey"))
    both = t.orders.select("o_orderkey", "o_custkey").join(lines, "o_orderkey").join(t.part.select("p_partkey", F.col("p_name").alias("source")), "p_partkey")
    return both.groupBy("o_custkey", "source").agg(F.countDistinct("l_suppkey").alias("records")).filter("records > 1")


@query("""
WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')
SELECT o_custkey, o_orderpriority FROM a JOIN b USING (o_custkey, o_orderpriority)
""")
def sources_read_twice(t: Tables) -> DataFrame:
    """Sources read both as a stub (status F) and as a verification (status O)."""
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderpriority").distinct()
    return side("F").join(side("O"), ["o_custkey", "o_orderpriority"], "left_semi")


@query("""
WITH c AS (SELECT o_custkey, count(*) FILTER (o_totalprice > 0) AS totals, count(*) FILTER (l.l_orderkey IS NOT NULL) AS lines FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F') l ON l.l_orderkey = o_orderkey AND o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey, CASE WHEN coalesce(totals, 0) = 0 THEN 'TIC_TOTAL_NOT_EXTRACTED' WHEN lines = 0 THEN 'TIC_TOTAL_NO_CALCULATIONS' END AS code FROM customer LEFT JOIN c ON o_custkey = c_custkey WHERE coalesce(totals, 0) = 0 OR lines = 0
""")
def certified_totals(t: Tables) -> DataFrame:
    """Cases without a certified total, or with one that nothing computed stands beside."""
    done = t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("k", F.lit(True))
    c = t.orders.join(done, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.when(F.col("o_totalprice") > 0, 1)).alias("totals"), F.count(F.when(F.col("k") & (F.col("o_orderstatus") == "P"), 1)).alias("lines"))
    code = F.when(F.coalesce("totals", F.lit(0)) == 0, "TIC_TOTAL_NOT_EXTRACTED").when(F.col("lines") == 0, "TIC_TOTAL_NO_CALCULATIONS")
    return t.customer.select("c_custkey").join(c, "c_custkey", "left").select("c_custkey", code.alias("code")).filter("code is not null")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, 'JOINT_ACCOUNT_OWNERSHIP_PCT' AS code FROM lineitem WHERE l_discount > 0 AND l_discount < 0.1 AND l_returnflag = 'R'
UNION ALL SELECT o_orderkey, NULL, NULL, 'NO_ASSET_CERT_MISSING' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def asset_worksheet(t: Tables) -> DataFrame:
    """Joint accounts owned in part, and cases without assets that lack the certificate that says so."""
    joint = t.lineitem.filter("l_discount > 0 and l_discount < 0.1 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("JOINT_ACCOUNT_OWNERSHIP_PCT").alias("code"))
    none = t.orders.select(F.col("o_orderkey").alias("l_orderkey")).join(t.lineitem.select("l_orderkey"), "l_orderkey", "left_anti")
    return joint.unionByName(none.withColumn("code", F.lit("NO_ASSET_CERT_MISSING")), allowMissingColumns=True)


@query("""
WITH c AS (SELECT o_orderkey, o_orderpriority, o_totalprice / 500000 AS score FROM orders WHERE o_orderstatus <> 'P'), m AS (SELECT o_orderpriority, avg(score) AS mean FROM c GROUP BY 1)
SELECT o.o_orderkey, frac4(coalesce(c.score, mean)) AS confidence FROM orders o LEFT JOIN c USING (o_orderkey) LEFT JOIN m ON m.o_orderpriority = o.o_orderpriority
""")
def attached_confidence(t: Tables) -> DataFrame:
    """Records with the confidence of their card, or of the cards of their label."""
    cards = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 500_000).alias("score"))
    return O.with_confidence(t.orders.select("o_orderkey", "o_orderpriority"), cards, "o_orderkey", "o_orderpriority").select("o_orderkey", nearest(F.col("confidence"), 4).alias("confidence"))


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS ord, arg_min(o_orderstatus, o_orderkey) AS code FROM orders GROUP BY 1, 2)
SELECT o_custkey, count(*) AS n, '[' || string_agg('{"code":"' || code || '","label":"' || o_orderpriority || '"}', ',' ORDER BY ord) || ']' AS payload FROM f GROUP BY 1
""")
def findings_payloads(t: Tables) -> DataFrame:
    """A case's findings, the first of each key, as an ordered JSON list."""
    rows = t.orders.select("o_custkey", F.col("o_orderpriority").alias("finding_key"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("label"))
    return O.findings_payload(rows, "o_custkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'Net pay' WHEN l_returnflag = 'N' THEN 'gross income' END AS label, l_extendedprice::DECIMAL(18,2)::DOUBLE AS amount, l_quantity::DECIMAL(18,2)::DOUBLE AS second FROM lineitem
""")
def labelled_amounts(t: Tables) -> DataFrame:
    """Amounts that a text prints, with the label before each."""
    x = F.col("l_extendedprice").cast("decimal(18,2)")
    label = F.when(F.col("l_returnflag") == "A", "Net pay: ").when(F.col("l_returnflag") == "N", "gross income - ").otherwise("")
    text = F.concat(label, F.lit("$"), F.format_number(x, 2), F.lit(" Total due $"), F.col("l_quantity").cast("decimal(18,2)").cast("string"))
    found = t.lineitem.withColumn("a", O.labelled_amounts(text))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.get("a", F.lit(0))["label"].alias("label"), F.get("a", F.lit(0))["amount"].alias("amount"), F.get("a", F.lit(1))["amount"].alias("second"))
