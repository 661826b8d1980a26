"""Normalisers over document-like strings made from table values; the oracle knows what each was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions import normalise as N
from hearthledger.plans.registry import Tables, query

_PRICE = "cast(o_totalprice as decimal(18,2))"


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (5, 6, 7) THEN NULL WHEN o_orderkey % 9 IN (2, 3) THEN -CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END::DOUBLE AS amount
FROM orders
""")
def normalize_money(t: Tables) -> DataFrame:
    """Amounts printed nine ways: grouped, spaced, bracketed, signed, with a unit; ranges, percents and dates are none."""
    plain, grouped = f"cast({_PRICE} as string)", f"format_number({_PRICE}, 2)"
    shown = F.expr(f"""CASE o_orderkey % 9 WHEN 0 THEN concat('$', {grouped}) WHEN 1 THEN replace({grouped}, ',', ', ') WHEN 2 THEN concat('(', {grouped}, ')')
      WHEN 3 THEN concat('-$', {plain}) WHEN 4 THEN concat({plain}, '/mo') WHEN 5 THEN concat({plain}, ' - ', {grouped}) WHEN 6 THEN concat({plain}, '%')
      WHEN 7 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE concat('USD ', {plain}) END""")
    return t.orders.select("o_orderkey", N.money_amount(shown).alias("amount"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 6 THEN NULL WHEN o_orderkey % 8 = 7 AND day(o_orderdate) < 10 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 8 = 7 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
FROM orders
""")
def normalize_date(t: Tables) -> DataFrame:
    """Dates printed in six shapes, a day that no calendar has, and an inserted digit (0 before a one-digit day)."""
    fmt = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 8
    shown = (
        F.when(k == 0, fmt("yyyy-MM-dd")).when(k == 1, fmt("MM/dd/yyyy")).when(k == 2, fmt("M/d/yy")).when(k == 3, fmt("MMMM d, yyyy")).when(k == 4, fmt("d MMM yyyy"))
        .when(k == 5, F.concat(fmt("yyyy-MM-dd"), F.lit("T08:30:00"))).when(k == 6, F.concat(fmt("yyyy"), F.lit("-02-30")))
        .otherwise(F.when(F.dayofmonth("o_orderdate") < 10, F.concat(fmt("MM"), F.lit("/00"), fmt("d"), F.lit("/"), fmt("yyyy"))).otherwise(F.lit("not listed")))
    )
    return t.orders.select("o_orderkey", F.date_format(N.date(shown, 2026), "yyyy-MM-dd").alias("day"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN NULL ELSE printf('%.2f', round(l_tax * 100)) END AS rate FROM lineitem
""")
def normalize_rate(t: Tables) -> DataFrame:
    """Percent figures with and without sign; above 100 is no rate."""
    p = F.round(F.col("l_tax") * 100).cast("int")
    k = F.col("l_linenumber") % 4
    shown = F.when(k == 0, F.concat(p.cast("string"), F.lit("%"))).when(k == 1, F.concat(p.cast("string"), F.lit(".0 APY"))).when(k == 2, F.concat(p.cast("string"), F.lit(" percent"))).otherwise((p + 101).cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", N.rate(shown).alias("rate"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 12 AND p_partkey % 3 < 2 THEN p_size END AS months FROM part")
def normalize_months(t: Tables) -> DataFrame:
    """Months a statement covers, whole and 1 to 12."""
    shown = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit(" months"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("covers "), "p_size")).otherwise(F.concat("p_size", F.lit(".5")))
    return t.part.select("p_partkey", N.months(shown).alias("months"))


_SSN_PARTS = "lpad(CAST((c_custkey * 37) % 1000 AS VARCHAR), 3, '0') AS a, lpad(CAST((c_custkey * 7) % 100 AS VARCHAR), 2, '0') AS g, lpad(CAST((c_custkey * 13) % 10000 AS VARCHAR), 4, '0') AS s"


@query(f"""
WITH p AS (SELECT c_custkey, {_SSN_PARTS} FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) AND a NOT IN ('000', '666') AND a NOT LIKE '9%' AND g <> '00' AND s <> '0000' THEN a || '-' || g || '-' || s WHEN c_custkey % 5 = 2 THEN '***-**-' || s WHEN c_custkey % 5 = 3 THEN '***-**-' || s END AS ssn,
  CASE WHEN c_custkey % 5 < 4 THEN '***-**-' || s ELSE '***-**-' || right('1990', 4) END AS masked FROM p
""")
def normalize_ssn(t: Tables) -> DataFrame:
    """Full, masked and last-four forms; never-issued numbers and dates are dropped; the mask keeps four digits."""
    pad = lambda m, mod, w: F.lpad((F.col("c_custkey") * m % mod).cast("string"), w, "0")
    a, g, s = pad(37, 1000, 3), pad(7, 100, 2), pad(13, 10_000, 4)
    k = F.col("c_custkey") % 5
    shown = F.when(k == 0, F.concat_ws("-", a, g, s)).when(k == 1, F.concat_ws("- ", a, g, s)).when(k == 2, F.concat(F.lit("XXX-XX-"), s)).when(k == 3, s).otherwise(F.lit("02/20/1990"))
    return t.customer.select("c_custkey", N.ssn(shown).alias("ssn"), N.mask_ssn(shown).alias("masked"))


@query("SELECT c_custkey, 'ID ***-**-' || lpad(CAST((c_custkey * 13) % 10000 AS VARCHAR), 4, '0') || ' acct 123456789' AS line FROM customer")
def mask_identifiers(t: Tables) -> DataFrame:
    """SSNs inside running text are masked, bare nine-digit runs are not."""
    line = F.format_string("ID %03d-%02d-%04d acct 123456789", F.col("c_custkey") % 899 + 1, F.col("c_custkey") % 99 + 1, F.col("c_custkey") * 13 % 10_000)
    return t.customer.select("c_custkey", N.mask_ssns_in_text(line).alias("line"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]')) AS shown FROM documents),
d AS (SELECT doc_id, shown, regexp_replace(shown, '[^0-9]', '', 'g') AS d FROM p),
n AS (SELECT doc_id, shown, CASE WHEN length(d) = 11 AND d[1] = '1' THEN substr(d, 2) ELSE d END AS d FROM d)
SELECT doc_id, shown, CASE WHEN length(d) = 10 THEN '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) END AS phone FROM n
""")
def phone_normalise(t: Tables) -> DataFrame:
    """Phone numbers printed in documents, in one form; other lengths are none."""
    shown = F.explode(F.expr(r"regexp_extract_all(text, r'\+[0-9][\x20().0-9-]+[0-9]', 0)"))
    return t.documents.select("doc_id", shown.alias("shown")).withColumn("phone", N.phone(F.col("shown")))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' -- ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slug_names(t: Tables) -> DataFrame:
    """Stable key fragments from names."""
    return t.part.select("p_partkey", N.slug(F.concat_ws(" -- ", "p_name", "p_brand")).alias("slug"))


@query("""
WITH w AS (SELECT p_partkey, p_partkey % 3 AS k, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
SELECT p_partkey, string_agg(upper(w[1]) || lower(substr(w, 2)), ' ' ORDER BY i) || CASE k WHEN 0 THEN ' LLC' WHEN 1 THEN ' Inc.' ELSE ' of McDonald' END AS name
FROM w GROUP BY p_partkey, k
""")
def title_case_names(t: Tables) -> DataFrame:
    """Capital names get title case with entity forms; lower tokens are capitalised; mixed tokens stay."""
    k = F.col("p_partkey") % 3
    mixed = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 99))), " ")
    shown = F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" LLC"))).when(k == 1, F.concat(F.lower(mixed), F.lit(" inc"))).otherwise(F.concat("p_name", F.lit(" OF McDonald")))
    return t.part.select("p_partkey", N.title_case(shown).alias("name"))


@query("""
WITH s(k, shown, canon, unit) AS (VALUES (0, 'Paid: Bi-Weekly', 'bi-weekly', 'bi-weekly'), (1, 'every other Friday', 'bi-weekly', 'bi-weekly'), (2, 'twice a month', 'semi-monthly', 'semi-monthly'),
  (3, ' WEEKLY. ', 'weekly', 'weekly'), (4, 'per annum', 'annually', 'annually'), (5, '$15/hr', 'hourly', 'hourly'), (6, 'each pay period', NULL, 'per_period'), (7, 'mthly', 'monthly', 'monthly'), (8, 'every 3 months', 'quarterly', 'quarterly'), (9, 'sometimes', NULL, NULL))
SELECT o_orderkey, canon AS frequency, CASE canon WHEN 'weekly' THEN 52 WHEN 'bi-weekly' THEN 26 WHEN 'semi-monthly' THEN 24 WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 WHEN 'annually' THEN 1 END AS periods, unit
FROM orders JOIN s ON k = o_orderkey % 10
""")
def pay_frequency(t: Tables) -> DataFrame:
    """Spellings of a pay frequency to its canonical form, periods a year and rate unit."""
    said = F.array(*map(F.lit, ("Paid: Bi-Weekly", "every other Friday", "twice a month", " WEEKLY. ", "per annum", "$15/hr", "each pay period", "mthly", "every 3 months", "sometimes")))
    shown = F.element_at(said, (F.col("o_orderkey") % 10 + 1).cast("int"))
    canon = N.frequency(shown)
    return t.orders.select("o_orderkey", canon.alias("frequency"), N.multiplier(canon).alias("periods"), N.rate_unit(shown).alias("unit"))


@query("""
WITH v(k, y) AS (VALUES (0, TRUE), (1, FALSE), (2, NULL), (3, TRUE), (4, FALSE))
SELECT c_custkey, y AS student, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance, c_acctbal < 0 AS overdrawn FROM customer JOIN v ON k = c_custkey % 5
""")
def tri_state_and_balance(t: Tables) -> DataFrame:
    """Y / N / unknown never collapse; an overdrawn balance leaves as zero with a mark."""
    shown = F.element_at(F.array(*map(F.lit, ("Y", "no", "n/a", "Yes", "N"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t.customer.select("c_custkey", N.tri_state(shown).alias("student"), F.greatest("c_acctbal", F.lit(0.0)).alias("balance"), (F.col("c_acctbal") < 0).alias("overdrawn"))


@query("SELECT o_orderkey, floor(date_diff('day', o_orderdate::DATE, DATE '2020-06-30') / 365.25)::INTEGER AS age FROM orders")
def age_on_day(t: Tables) -> DataFrame:
    """Whole years between a birth date and a given day, by 365.25."""
    return t.orders.select("o_orderkey", N.age_on(F.col("o_orderdate").cast("date"), F.lit("2020-06-30").cast("date")).alias("age"))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS page FROM lineitem WHERE l_linenumber <> 3),
g AS (SELECT l_orderkey, page, page - row_number() OVER (PARTITION BY l_orderkey ORDER BY page) AS island FROM p),
s AS (SELECT l_orderkey, min(page) AS a, max(page) AS b FROM g GROUP BY l_orderkey, island)
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END, ', ' ORDER BY a) AS pages FROM s GROUP BY 1
""")
def page_spans_text(t: Tables) -> DataFrame:
    """Page lists as spans: 1-2, 4."""
    return t.lineitem.filter("l_linenumber <> 3").groupBy("l_orderkey").agg(N.page_span(F.collect_set("l_linenumber")).alias("pages"))


@query("""
SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'brass' WHEN lower(p_type) LIKE '%steel%' THEN 'steel' WHEN lower(p_type) LIKE '%copper%' THEN 'copper' ELSE 'other' END AS picked FROM part
""")
def picklist_map(t: Tables) -> DataFrame:
    """Free vocabulary to a picklist by a broadcast dimension, else 'other'."""
    picks = t.spark.createDataFrame([("brass", 0), ("steel", 1), ("copper", 2)], "term string, ord int")
    hit = t.part.join(F.broadcast(picks), F.lower("p_type").contains(F.col("term")), "left")
    return hit.groupBy("p_partkey").agg(F.coalesce(F.min_by("term", "ord"), F.lit("other")).alias("picked"))
