"""Validation rules bound to orders (declarations), lines (evidence), customers (members) and suppliers (payers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.normalise import nearest
from hearthledger.operators import rules as V
from hearthledger.plans.registry import Tables, query

_SLUG = "regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS computed FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey, o_totalprice AS declared, computed FROM orders JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey, declared, computed, CASE WHEN declared <= 0 THEN NULL WHEN abs(computed - declared) / declared > 0.15 AND abs(computed - declared) > 100 THEN 'TIC_TOTAL_MISMATCH' WHEN abs(computed - declared) / declared > 0.05 AND abs(computed - declared) > 100 THEN 'TIC_TOTAL_MINOR_DIFF' ELSE 'OK' END AS band FROM b
""")
def declared_vs_computed(t: Tables) -> DataFrame:
    """Declared totals against the sum of their lines, in bands."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("computed"))
    both = t.orders.select("o_orderkey", F.col("o_totalprice").alias("declared")).join(s, "o_orderkey")
    return both.withColumn("band", V.total_band(F.col("declared"), F.col("computed")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, cents(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS gross, cents(l_extendedprice * (1 - l_discount)) AS tenant FROM lineitem
WHERE abs(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice * (1 - l_discount)) > 1.0
""")
def rent_identity(t: Tables) -> DataFrame:
    """Lines whose gross differs from tenant plus allowance by more than a dollar."""
    tenant = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    gross = tenant * (1 + F.col("l_tax"))
    return t.lineitem.filter(F.abs(gross - tenant) > 1.0).select("l_orderkey", "l_linenumber", "l_partkey", nearest(gross).alias("gross"), nearest(tenant).alias("tenant"))


_OVERDRAWN = f"SELECT 'ASSET_OVERDRAWN' AS code, 'ASSET_OVERDRAWN:' || {_SLUG.format('c_name')} || ':' || lower(c_mktsegment) AS finding_key, c_custkey AS ord FROM customer WHERE c_acctbal < 0"


def _overdrawn(t: Tables) -> DataFrame:
    rows = t.customer.filter("c_acctbal < 0")
    return V.finding(rows, "ASSET_OVERDRAWN", {"member": F.col("c_name"), "type": F.col("c_mktsegment")}, F.col("c_name"), "asset")


@query(f"SELECT code, finding_key FROM ({_OVERDRAWN})")
def overdrawn_accounts(t: Tables) -> DataFrame:
    """Accounts below zero as keyed findings."""
    return _overdrawn(t).select("code", "finding_key")


@query(f"""
WITH f AS (SELECT 'NEG' AS code, 'NEG:' || {_SLUG.format('n_name')} AS finding_key, c_custkey AS ord, c_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0)
SELECT code, finding_key, text FROM (SELECT *, row_number() OVER (PARTITION BY finding_key ORDER BY ord) AS p FROM f) WHERE p = 1
""")
def finding_dedupe(t: Tables) -> DataFrame:
    """Findings of one key collapse to the first seen."""
    rows = t.customer.filter("c_acctbal < 0").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    keyed = rows.select(F.lit("NEG").alias("code"), V.finding_key(F.lit("NEG"), F.create_map(F.lit("nation"), F.col("n_name"))).alias("finding_key"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("text"))
    return V.first_seen(keyed, "finding_key", ["ord"]).drop("ord")


@query("""
SELECT o_orderkey, l_linenumber, l_partkey, CASE WHEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) < -365 THEN 'CERT_SIGNATURE_DATE_IMPLAUSIBLE' WHEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 14 THEN 'CERT_SIGNED_AFTER_EFFECTIVE_DATE' END AS code
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 14 OR date_diff('day', o_orderdate::DATE, l_shipdate::DATE) < -365
""")
def signature_dates(t: Tables) -> DataFrame:
    """Ship days as signatures against order days as effective dates."""
    both = t.orders.select("o_orderkey", "o_orderdate").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_shipdate"), "o_orderkey")
    code = V.signature_finding(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return both.select("o_orderkey", "l_linenumber", "l_partkey", code.alias("code")).filter("code IS NOT NULL")


@query("""
WITH r(d) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'))
SELECT c_custkey, d AS document FROM customer, r WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = d)
""")
def required_documents(t: Tables) -> DataFrame:
    """Required documents (priorities) that a member's file lacks."""
    need = t.customer.select("c_custkey", F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))).alias("document"))
    return V.missing(need, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("document")), ["c_custkey", "document"])


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS declared FROM lineitem GROUP BY 1) SELECT l_orderkey, declared, n AS counted FROM c WHERE n <> declared
""")
def household_size(t: Tables) -> DataFrame:
    """Declared sizes that differ from the members counted."""
    c = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("declared"), F.count("*").alias("counted"))
    return c.filter("declared <> counted")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT o_custkey, NULL, NULL, count(*) FROM orders GROUP BY o_custkey, o_orderdate, o_orderpriority HAVING count(*) > 1
""")
def duplicate_records(t: Tables) -> DataFrame:
    """Records equal on their full identity."""
    lines = t.lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1")
    orders = t.orders.groupBy("o_custkey", "o_orderdate", "o_orderpriority").agg(F.count("*").alias("n")).filter("n > 1")
    return lines.unionByName(orders.select(F.col("o_custkey").alias("l_orderkey"), F.lit(None).cast("long").alias("l_partkey"), F.lit(None).cast("long").alias("l_suppkey"), "n"))


@query("""
WITH d AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS employed, bool_or(o_orderstatus = 'F') AS proven FROM orders GROUP BY 1)
SELECT o_custkey, employed AND NOT proven AS unverified, CASE WHEN employed AND NOT proven THEN 'QUESTIONNAIRE_EMPLOYMENT_UNVERIFIED' END AS code FROM d
""")
def affirmative_responses(t: Tables) -> DataFrame:
    """Yes on the questionnaire without a document that proves it; three-valued folding over documents."""
    d = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("employed"), F.bool_or(F.col("o_orderstatus") == "F").alias("proven"))
    unverified = F.col("employed") & ~F.col("proven")
    return d.select("o_custkey", unverified.alias("unverified"), F.when(unverified, "QUESTIONNAIRE_EMPLOYMENT_UNVERIFIED").alias("code"))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS computed, count(*) AS n, max(l_linenumber) AS declared FROM lineitem GROUP BY 1),
f AS (SELECT o_custkey, o_orderkey, 'TIC_TOTAL_MISMATCH' AS code FROM orders JOIN s ON l_orderkey = o_orderkey WHERE abs(computed - o_totalprice) > 0.15 * o_totalprice AND abs(computed - o_totalprice) > 100
  UNION ALL SELECT o_custkey, o_orderkey, 'HH_SIZE_MISMATCH' FROM orders JOIN s ON l_orderkey = o_orderkey WHERE n <> declared
  UNION ALL SELECT o_custkey, min(o_orderkey), 'DUPLICATE_EMPLOYER' FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)
SELECT o_custkey, count(*) AS findings, min(CASE WHEN code IN ('INCOME_METHODS_DISAGREE', 'DUPLICATE_EMPLOYER') THEN 0.5 ELSE 0.15 END)::DOUBLE AS lowest FROM f GROUP BY 1
""")
def dispute_scores(t: Tables) -> DataFrame:
    """The lowest score that findings put on a record, by code strength."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("computed"), F.count("*").alias("n"), F.max("l_linenumber").alias("declared"))
    both = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").join(s, "o_orderkey")
    found = lambda df, code: df.select("o_custkey", F.lit(code).alias("code"))
    totals = found(both.filter(V.total_band(F.col("o_totalprice"), F.col("computed")) == "TIC_TOTAL_MISMATCH"), "TIC_TOTAL_MISMATCH")
    size = found(both.filter("n <> declared"), "HH_SIZE_MISMATCH")
    twice = found(t.orders.groupBy("o_custkey", "o_orderpriority").count().filter("count > 1"), "DUPLICATE_EMPLOYER")
    return V.gathered([totals, size, twice]).groupBy("o_custkey").agg(F.count("*").alias("findings"), F.min(V.dispute_strength(F.col("code"))).alias("lowest"))


@query("""
SELECT c_custkey, substr(sha1(regexp_replace(lower(c_name || ' balance ' || c_acctbal::DECIMAL(18,2)), '[0-9]', '', 'g')), 1, 12) AS note_key FROM customer
""")
def note_keys(t: Tables) -> DataFrame:
    """Keys of plain notes: digits dropped, lower-cased, hashed."""
    note = F.concat_ws(" ", "c_name", F.lit("balance"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return t.customer.select("c_custkey", F.substring(F.sha1(F.regexp_replace(F.lower(note), "[0-9]", "")), 1, 12).alias("note_key"))
