"""Taxonomy, rules and scores bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions import pagetext as P
from hearthledger.functions.normalise import nearest
from hearthledger.operators import review as V
from hearthledger.operators import taxonomy as X
from hearthledger.plans.registry import Tables, query

# nations are the taxonomy: the region is the family, a short form an alias; segments decide how a customer prints the label
_TAXONOMY = "SELECT n_name AS label, ['N-' || n_nationkey] AS aliases, CASE WHEN n_regionkey = 0 THEN 'cert' WHEN n_regionkey = 1 THEN 'income' WHEN n_regionkey = 2 THEN 'asset' ELSE 'other' END AS category, r_name AS family, n_nationkey % 6 = 0 AS hud_only, CASE WHEN n_nationkey % 4 = 1 THEN 'NATION_' || (n_nationkey - 1) END AS confirms FROM nation JOIN region ON r_regionkey = n_regionkey"
_PRINTED = "SELECT c_custkey, c_custkey % 50 AS hh, CASE c_mktsegment WHEN 'BUILDING' THEN n_name WHEN 'AUTOMOBILE' THEN lower('N-' || n_nationkey) WHEN 'MACHINERY' THEN n_name || ' (Previous)' WHEN 'HOUSEHOLD' THEN '  ' || lower(n_name) || ' ' ELSE c_mktsegment END AS printed FROM customer JOIN nation ON n_nationkey = c_nationkey"
_LABELLED = f"""t AS ({_TAXONOMY}), p AS ({_PRINTED}), b AS (SELECT *, CASE WHEN trim(printed) LIKE '% (Previous)' THEN ' (Previous)' ELSE '' END AS suffix, lower(replace(trim(printed), ' (Previous)', '')) AS base FROM p),
g AS (SELECT c_custkey, hh, printed, suffix, coalesce(t1.label, t2.label) AS label, CASE WHEN t1.label IS NOT NULL THEN 'exact' WHEN t2.label IS NOT NULL THEN 'alias' ELSE 'none' END AS fit, coalesce(t1.category, t2.category) AS cat, coalesce(t1.family, t2.family, 'ignore') AS family, coalesce(t1.hud_only, t2.hud_only, false) AS hud_only, coalesce(t1.confirms, t2.confirms) AS confirms
  FROM b LEFT JOIN t t1 ON lower(t1.label) = base LEFT JOIN t t2 ON lower(t2.aliases[1]) = base),
l AS (SELECT c_custkey, hh, coalesce(label || suffix, 'Unknown') AS canonical, fit, CASE WHEN suffix <> '' OR cat IS NULL THEN 'ignore' ELSE cat END AS category, family, hud_only, confirms FROM g)"""


def _taxonomy(t: Tables) -> DataFrame:
    n = t.nation.join(X.dimension(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    key = F.col("n_nationkey")
    category = F.when(F.col("n_regionkey") == 0, "cert").when(F.col("n_regionkey") == 1, "income").when(F.col("n_regionkey") == 2, "asset").otherwise("other")
    return n.select(
        F.col("n_name").alias("label"), F.array(F.concat(F.lit("N-"), key.cast("string"))).alias("aliases"), category.alias("category"), F.col("r_name").alias("family"),
        F.array(F.lower("r_name")).alias("routes"), (key % 6 == 0).alias("hud_only"), F.when(key % 4 == 1, F.concat(F.lit("NATION_"), (key - 1).cast("string"))).alias("confirms"),
    )


def _printed(t: Tables) -> DataFrame:
    name, s = F.col("n_name"), F.col("c_mktsegment")
    short = F.lower(F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")))
    text = F.when(s == "BUILDING", name).when(s == "AUTOMOBILE", short).when(s == "MACHINERY", F.concat(name, F.lit(" (Previous)"))).when(s == "HOUSEHOLD", F.concat(F.lit("  "), F.lower(name), F.lit(" "))).otherwise(s)
    return t.customer.join(X.dimension(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", (F.col("c_custkey") % 50).alias("case"), text.alias("printed"))


def _labelled(t: Tables) -> DataFrame:
    return X.labelled(_printed(t), "printed", _taxonomy(t))


@query(f"WITH {_LABELLED} SELECT c_custkey, canonical, fit, category, family, hud_only, confirms FROM l")
def taxonomy_labels(t: Tables) -> DataFrame:
    """Printed labels resolved by name, alias and suffix, with their attributes."""
    return _labelled(t).select("c_custkey", "canonical", "fit", "category", "family", "hud_only", "confirms")


@query(f"WITH {_LABELLED}, r AS (SELECT lower(family) AS route, count(*) AS n FROM t GROUP BY 1) SELECT route, n AS labels, (SELECT count(*) FROM l WHERE fit = 'none') AS unknown FROM r")
def taxonomy_routes(t: Tables) -> DataFrame:
    """Labels of each route, beside the number of printed labels that the taxonomy lacks."""
    routes = _taxonomy(t).select(F.explode("routes").alias("route")).groupBy("route").agg(F.count("*").alias("labels"))
    unknown = _labelled(t).agg(F.count(F.when(F.col("fit") == "none", 1)).alias("unknown"))
    return routes.join(F.broadcast(unknown), F.lit(True))  # one row


_CASES = "SELECT s_suppkey AS hh, (['Section 8', 'Section 42', 'RAD', 'Colorado HFA', 'USDA rural development', 'section  811'])[s_suppkey % 6 + 1] AS programme FROM supplier WHERE s_suppkey < 50"


@query(f"""
WITH c AS ({_CASES}), {_LABELLED}, f AS (SELECT hh, bool_or(contains(canonical, 'NATION_3') AND NOT contains(canonical, '(Previous)')) AS form FROM l GROUP BY 1),
h AS (SELECT c.hh, regexp_matches(lower(programme), '\\b(hud|usda|rural\\s+development|rd|rad|prac|pbra|pbv|public\\s+housing|section\\s*(8|202|811|236|221|515))\\b') OR coalesce(form, false) AS hud FROM c LEFT JOIN f USING (hh))
SELECT l.c_custkey, CASE WHEN hud_only AND fit <> 'exact' AND NOT coalesce(hud, false) THEN 'Unknown' ELSE canonical END AS label, coalesce(hud, false) AS hud FROM l LEFT JOIN h USING (hh)
""".replace("\\\\", "\\"))
def hud_demotions(t: Tables) -> DataFrame:
    """Near matches onto housing-authority labels are dropped in cases of other programmes."""
    programmes = F.array(*map(F.lit, ("Section 8", "Section 42", "RAD", "Colorado HFA", "USDA rural development", "section  811")))
    cases = t.supplier.filter("s_suppkey < 50").select(F.col("s_suppkey").alias("case"), F.get(programmes, (F.col("s_suppkey") % 6).cast("int")).alias("programme"))
    groups = _labelled(t)
    hud = X.hud_cases(cases, groups.select("case", F.col("canonical").alias("label")), "NATION_3")
    return X.demoted(groups, hud).join(hud, "case", "left").select("c_custkey", "label", F.coalesce("hud", F.lit(False)).alias("hud"))


@query(f"WITH {_LABELLED} SELECT DISTINCT hh AS \"case\", confirms AS report FROM l WHERE category <> 'ignore' AND confirms IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l o WHERE o.hh = l.hh AND o.category <> 'ignore' AND o.canonical = l.confirms)")
def confirmation_reports(t: Tables) -> DataFrame:
    """Reports that a confirmation restates and the case lacks."""
    return V.confirmations_without_report(_labelled(t))


@query("""
WITH g AS (SELECT l_orderkey AS c, l_linenumber * 2 AS page, l_returnflag AS label, CASE WHEN l_linestatus = 'F' THEN 0.9 ELSE 0.6 END AS conf FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber * 2 + 1, l_returnflag, CASE WHEN l_linestatus = 'F' THEN 0.9 ELSE 0.6 END FROM lineitem WHERE l_quantity > 25),
b AS (SELECT c, page, arg_max(label, (conf, label)) AS label, max(conf) AS conf FROM g GROUP BY 1, 2), p AS (SELECT o_orderkey AS c, unnest(range(2, 16)) AS page FROM orders)
SELECT p.c AS "case", p.page::INT AS page, coalesce(b.label, 'Unknown') AS label, coalesce(conf, 0.0)::DOUBLE AS confidence FROM p LEFT JOIN b ON b.c = p.c AND b.page = p.page
""")
def classified_pages(t: Tables) -> DataFrame:
    """Pages of document groups with their confidence, and pages that no group holds."""
    n = F.col("l_linenumber") * 2
    pages = F.when(F.col("l_quantity") > 25, F.array(n, n + 1)).otherwise(F.array(n))
    groups = t.lineitem.select(F.col("l_orderkey").alias("case"), F.col("l_returnflag").alias("label"), F.when(F.col("l_linestatus") == "F", "exact").otherwise("alias").alias("fit"), pages.alias("pages"))
    groups = groups.join(t.orders.select(F.col("o_orderkey").alias("case")), "case", "left_semi")
    return X.page_rows(groups, t.orders.select(F.col("o_orderkey").alias("case"), F.explode(F.sequence(F.lit(2), F.lit(15))).alias("page")))


@query("""
WITH n AS (SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS file FROM orders GROUP BY 1, 2)
SELECT o_orderkey, o_orderstatus = file AS current FROM orders JOIN n USING (o_custkey, o_orderpriority)
""")
def superseded_groups(t: Tables) -> DataFrame:
    """Of a label in several source files only the newest file's groups count."""
    g = t.orders.select(F.col("o_custkey").alias("case"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("file"), F.col("o_orderdate").alias("day"), "o_orderkey")
    return X.superseded(g).select("o_orderkey", "current")


@query("""
WITH RECURSIVE a AS (SELECT l_orderkey, list(round(l_extendedprice * 100)::BIGINT ORDER BY l_linenumber, l_partkey, l_extendedprice) AS x FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, x, 1 AS i, 0::BIGINT AS v FROM a UNION SELECT l_orderkey, x, i + 1, v + k * x[i] FROM s, (VALUES (0), (1)) AS t(k) WHERE i <= len(x) AND len(x) <= 9),
d AS (SELECT l_orderkey, count(DISTINCT v) AS n, max(v) / 100 AS most FROM s WHERE i = len(x) + 1 GROUP BY 1)
SELECT l_orderkey, n, most FROM d
""")
def reachable_totals(t: Tables) -> DataFrame:
    """How many totals an order's lines can sum up to, and the largest; orders of up to nine lines, whose sums the recursion in SQL can list."""
    amounts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))), lambda x: x["l_extendedprice"])
    lines = t.lineitem.groupBy("l_orderkey").agg(amounts.alias("x")).filter(F.size("x") <= 9)
    sums = lines.select("l_orderkey", V.reachable_sums(F.col("x")).alias("s"))
    return sums.select("l_orderkey", F.size("s").cast("long").alias("n"), F.array_max("s").alias("most"))


_FIGURES = "SELECT l_orderkey, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_extendedprice) AS m FROM lineitem GROUP BY 1"


@query(f"""
WITH f AS ({_FIGURES}), b AS (SELECT o_orderkey, o_totalprice AS declared, list_distinct([c_acctbal] || [round(list_sum(m) / len(m), 2)]) AS v FROM orders JOIN f ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, len(v) AS figures, len(list_filter(v, lambda x: abs(declared - x) <= 0.1 * greatest(abs(declared), abs(x)))) = 0 AS differs FROM b
""")
def asset_consistency(t: Tables) -> DataFrame:
    """Declared balances that no stated figure (balance, or mean of the monthly ones) is near."""
    m = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))), lambda x: x["l_extendedprice"]).alias("m"))
    b = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").join(m, "o_orderkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    figures = b.withColumn("v", V.verified_figures(F.array("c_acctbal"), F.col("m")))
    return figures.select("o_orderkey", F.size("v").cast("long").alias("figures"), V.declared_off(F.col("o_totalprice"), F.col("v")).alias("differs"))


@query("""
WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice::DECIMAL(18,2) * 100)::DOUBLE AS balance FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY month DESC) AS p FROM m)
SELECT o_custkey, cents(sum(balance) / count(*) / 100) AS mean FROM r WHERE p <= 6 GROUP BY 1
""")
def six_month_balance(t: Tables) -> DataFrame:
    """Mean of the last six monthly balances."""
    m = t.orders.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 100).cast("double").alias("balance"))  # whole cents add up exactly
    each = m.groupBy("o_custkey").agg(F.collect_list(F.struct("month", "balance")).alias("b"))
    return each.select("o_custkey", nearest(V.monthly_mean(F.col("b")) / 100).alias("mean"))


@query("""
WITH p AS (SELECT l_orderkey, list(l_quantity) AS q, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, q, s, n, CASE o_orderkey % 3 WHEN 0 THEN s WHEN 1 THEN q[1] ELSE s * 12 END AS stated FROM orders JOIN p ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN NOT (list_contains(q, stated) OR (s = stated AND n > 1)) THEN stated END AS income FROM o WHERE o_orderkey % 3 <> 1 OR n > 0
""")
def income_from_assets(t: Tables) -> DataFrame:
    """Income stated for an asset, unless it repeats a period's figure or their sum."""
    p = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_quantity").alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    stated = F.when(F.col("o_orderkey") % 3 == 0, total).when(F.col("o_orderkey") % 3 == 1, F.get("q", F.lit(0))).otherwise(total * 12)
    return t.orders.select("o_orderkey").join(p, "o_orderkey").select("o_orderkey", V.asset_income(stated, F.col("q")).alias("income"))


_METHODS = "SELECT l_orderkey AS o_orderkey, l_linenumber AS ord, (['voi-based', 'history-based', 'self-declared', 'ytd-based', 'paystub-based', 'guess'])[l_suppkey % 6 + 1] AS method, CASE WHEN l_partkey % 5 = 0 THEN '[audit] x' WHEN l_partkey % 5 = 1 THEN '[historical] y' ELSE 'z' END AS details, l_extendedprice AS annual, l_partkey FROM lineitem"


@query(f"""
WITH m AS ({_METHODS}), b AS (SELECT o_orderkey, arg_min(annual, (CASE method WHEN 'voi-based' THEN 0 WHEN 'history-based' THEN 0 WHEN 'self-declared' THEN 1 WHEN 'ytd-based' THEN 2 WHEN 'paystub-based' THEN 3 ELSE 99 END, ord * 1000000 + l_partkey, annual)) AS annual FROM m WHERE details = 'z' GROUP BY 1)
SELECT o_orderkey, o_totalprice AS declared, annual, CASE WHEN annual > o_totalprice THEN 'higher' ELSE 'lower' END AS direction FROM orders JOIN b USING (o_orderkey) WHERE o_totalprice > 0 AND o_orderstatus <> 'P' AND abs(annual - o_totalprice) / o_totalprice > 0.10
""")
def summary_mismatches(t: Tables) -> DataFrame:
    """Certified figures more than a tenth off the figure of the method that speaks first."""
    names = F.array(*map(F.lit, ("voi-based", "history-based", "self-declared", "ytd-based", "paystub-based", "guess")))
    details = F.when(F.col("l_partkey") % 5 == 0, "[audit] x").when(F.col("l_partkey") % 5 == 1, "[historical] y").otherwise("z")
    calcs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord"), F.get(names, (F.col("l_suppkey") % 6).cast("int")).alias("method"), details.alias("details"), F.col("l_extendedprice").alias("annual"))
    records = t.orders.select("o_orderkey", F.col("o_totalprice").alias("declared"), F.when(F.col("o_orderstatus") == "P", "declared_only").alias("status"))
    return V.summary_mismatch(records, calcs, ["o_orderkey"])


@query("""
WITH g AS (SELECT o_custkey, count(*) AS documents FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE greatest(c_acctbal, 0) END AS federal, CASE WHEN c_custkey % 4 = 0 THEN 0.0 END AS other FROM customer)
SELECT c_custkey AS "case", documents FROM c JOIN g ON o_custkey = c_custkey WHERE (federal IS NOT NULL OR other IS NOT NULL) AND coalesce(federal, 0) = 0 AND coalesce(other, 0) = 0
""")
def rent_assistance(t: Tables) -> DataFrame:
    """Assistance documented but certified as zero; a figure nobody read is no zero."""
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "HomeBASE award letter").when(F.col("o_orderpriority") == "2-HIGH", "Housing Voucher").otherwise("Lease")
    groups = t.orders.select(F.col("o_custkey").alias("case"), label.alias("label"), F.when(F.col("o_orderstatus") == "P", "ignore").otherwise("cert").alias("category"))
    federal = F.when(F.col("c_custkey") % 3 != 0, F.greatest("c_acctbal", F.lit(0.0)))
    certified = t.customer.select(F.col("c_custkey").alias("case"), federal.alias("federal"), F.when(F.col("c_custkey") % 4 == 0, 0.0).alias("other"))
    return V.assistance_missing(groups, certified)


@query("""
WITH m AS (SELECT c_custkey, c_custkey % 80 AS age, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey = 3 THEN '000-00-0000' WHEN c_nationkey = 4 THEN '***-**-9999' WHEN c_nationkey = 5 THEN '' ELSE '123-45-6789' END AS ssn FROM customer)
SELECT c_custkey, CASE WHEN ssn IS NULL OR ssn = '' THEN 'MEMBER_SSN_MISSING' ELSE 'MEMBER_SSN_PLACEHOLDER' END AS code FROM m WHERE age > 6 AND (ssn IS NULL OR ssn IN ('', '000-00-0000', '***-**-9999'))
""")
def member_numbers(t: Tables) -> DataFrame:
    """Members over six without a social security number, or with a placeholder."""
    n = F.col("c_nationkey")
    number = F.when(F.col("c_acctbal") < 0, None).when(n == 3, "000-00-0000").when(n == 4, "***-**-9999").when(n == 5, "").otherwise("123-45-6789")
    return t.customer.select("c_custkey", V.social_security_finding(number, F.col("c_custkey") % 80).alias("code")).filter("code is not null")


@query("""
WITH f AS (SELECT c_custkey, unnest(['c_name', 'c_acctbal', 'c_mktsegment', 'phone', 'c_custkey_text']) AS field, unnest([c_name, c_acctbal::DECIMAL(18,2)::VARCHAR, CASE WHEN c_nationkey = 7 THEN '<TD>' || c_mktsegment ELSE c_mktsegment END, NULL, (c_custkey * 100)::VARCHAR]) AS v FROM customer)
SELECT c_custkey, field, (CASE WHEN v IS NULL THEN 0.0 WHEN regexp_matches(lower(v), '<td|<tr|</t|&amp;|colspan') OR regexp_matches(v, '^[0-9]{5,}$') THEN 0.60 ELSE 0.85 END)::DOUBLE AS score, CASE WHEN v IS NULL THEN 'absent' WHEN regexp_matches(lower(v), '<td|<tr|</t|&amp;|colspan') OR regexp_matches(v, '^[0-9]{5,}$') THEN 'suspicious' ELSE 'populated' END AS reason FROM f
""")
def extraction_scores(t: Tables) -> DataFrame:
    """Every field of a record by what was read: populated, suspicious, absent."""
    marked = F.when(F.col("c_nationkey") == 7, F.concat(F.lit("<TD>"), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    rows = t.customer.select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"), marked.alias("c_mktsegment"), F.lit(None).cast("string").alias("phone"), (F.col("c_custkey") * 100).alias("c_custkey_text"))
    return V.extraction_scores(rows, "c_custkey", ["c_name", "c_acctbal", "c_mktsegment", "phone", "c_custkey_text"])


_FIELDS = "SELECT l_orderkey, l_linenumber, l_discount * 10 AS score, l_tax = 0 AS na, l_returnflag = 'A' AS declared_only, l_quantity > 45 AS disputed FROM lineitem"


@query(f"WITH f AS ({_FIELDS}) SELECT l_orderkey, frac4(least(avg(score) FILTER (NOT na), CASE WHEN bool_or(declared_only) THEN 0.60 ELSE 1.0 END, CASE WHEN bool_or(disputed) THEN 0.79 ELSE 1.0 END)) AS score FROM f GROUP BY 1 HAVING count(*) FILTER (NOT na) > 0")
def record_confidence(t: Tables) -> DataFrame:
    """Confidence of a record from its fields; declared-only and disputed ones are capped."""
    f = t.lineitem.select("l_orderkey", (F.col("l_discount") * 10).alias("score"), (F.col("l_tax") == 0).alias("na"), (F.col("l_returnflag") == "A").alias("declared_only"), (F.col("l_quantity") > 45).alias("disputed"))
    known = f.filter("not na").select("l_orderkey").distinct()
    return V.record_scores(f, "l_orderkey").join(known, "l_orderkey", "left_semi").select("l_orderkey", nearest(F.col("score"), 4).alias("score"))


@query("SELECT o_custkey, frac4(round(sum(o_totalprice / 1000000 * CASE WHEN o_orderpriority = '1-URGENT' THEN 3.0 ELSE 1.0 END) / sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 3.0 ELSE 1.0 END) * greatest(0.5, 1 - 0.08 * (max(o_custkey) % 9)), 6)) AS score FROM orders GROUP BY 1")
def case_confidence(t: Tables) -> DataFrame:
    """Confidence of a case: headline fields three times, times coverage."""
    f = t.orders.select("o_custkey", (F.col("o_totalprice") / 1_000_000).alias("score"), "o_orderpriority")
    found = V.case_score(f, "o_custkey", F.col("o_orderpriority") == "1-URGENT", F.greatest(F.lit(0.5), 1 - 0.08 * (F.col("o_custkey") % 9)))
    return found.select("o_custkey", nearest(F.col("score"), 4).alias("score"))


@query("""
WITH e AS (SELECT b.item_id, bool_or(d.source = 'src' || b.item_id % 20) AS own, count(d.doc_id) > 0 AS hit FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1)
SELECT item_id, (CASE WHEN coalesce(own, false) THEN 1.0 WHEN hit THEN 0.7 * 0.9 ELSE 0.3 * 0.9 END)::DOUBLE AS score, (CASE WHEN coalesce(own, false) THEN 1.0 WHEN hit THEN 0.79 ELSE 0.49 END)::DOUBLE AS ceiling FROM e
""")
def source_evidence(t: Tables) -> DataFrame:
    """A value's score by where it is printed: the source it names, another, nowhere."""
    from hearthledger.plans.pages import passage_hits

    hits = passage_hits(t).join(t.documents.select("doc_id", "source"), "doc_id")
    e = t.benchmark.select("item_id").join(hits, "item_id", "left").groupBy("item_id").agg(F.bool_or(F.col("source") == F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("own"), (F.count("doc_id") > 0).alias("hit"))
    tier = V.evidence_tier(F.coalesce("own", F.lit(False)), F.col("hit"), F.lit(0.9), F.lit(True))
    return e.withColumn("e", tier).select("item_id", "e.score", "e.ceiling")


_PAD = "unhex(array_to_string(list_transform(range(1, 65), lambda i: printf('%02x', xor(CASE WHEN i <= length(k) THEN ord(substr(k, i::INT, 1)) ELSE 0 END, {}))), ''))"


@query(f"WITH m AS (SELECT event_id, 'key-' || user_id AS k, encode(coalesce(props, '')) AS msg FROM events) SELECT event_id, sha256({_PAD.format(92)} || unhex(sha256({_PAD.format(54)} || msg))) AS signature FROM m")
def signed_requests(t: Tables) -> DataFrame:
    """HMAC-SHA256 of event properties under a key of the user."""
    return t.events.select("event_id", V.hmac_sha256(F.concat(F.lit("key-"), F.col("user_id").cast("string")), F.coalesce("props", F.lit(""))).alias("signature"))


@query("""
WITH m AS (SELECT event_id, (['read timeout', 'HTTP 429 rate limit', 'HTTP 503 unavailable', 'invalid key', 'HTTP 401 unauthorized', 'connection reset'])[event_id % 6 + 1] || ' ' || event_type AS msg FROM events)
SELECT event_id, regexp_matches(lower(msg), 'timeout|timed out|429|rate limit|5[0-9]{2}|connection|temporar|unavailable') AND NOT regexp_matches(lower(msg), 'invalid|unauthori|forbidden|40[0134]') AS again FROM m
""")
def retry_classes(t: Tables) -> DataFrame:
    """Failures that are worth another try."""
    messages = F.array(*map(F.lit, ("read timeout", "HTTP 429 rate limit", "HTTP 503 unavailable", "invalid key", "HTTP 401 unauthorized", "connection reset")))
    return t.events.select("event_id", V.retryable(F.concat_ws(" ", F.get(messages, (F.col("event_id") % 6).cast("int")), "event_type")).alias("again"))


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, min(ts) AS created, count(*) FILTER (event_type = 'error') AS retries, max(props) FILTER (event_type = 'signup') AS request FROM events GROUP BY 1)
SELECT user_id AS "case", strftime(created, '%Y-%m-%d %H:%M:%S') AS created, CASE WHEN request IS NOT NULL AND retries < 16 THEN 'resume' ELSE 'fail' END AS action FROM s WHERE state IN ('view', 'signup', 'click')
""")
def resumed_cases(t: Tables) -> DataFrame:
    """Work interrupted while owned: resumed with its request, or failed."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    jobs = t.events.groupBy(F.col("user_id").alias("case")).agg(last.alias("state"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("created"), F.count(F.when(F.col("event_type") == "error", 1)).alias("retries"), F.max(F.when(F.col("event_type") == "signup", F.col("props"))).alias("request"))
    return V.resumable(jobs, ("view", "signup", "click"), 16)


@query("""
SELECT l_orderkey, '[' || string_agg('{"ref":"m' || lpad(p::VARCHAR, 2, '0') || '","flag":"' || l_returnflag || '","part":' || l_partkey || '}', ',' ORDER BY p) || ']' AS payload
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS p FROM lineitem) GROUP BY 1
""")
def member_payloads(t: Tables) -> DataFrame:
    """Members of a case as an ordered JSON list with references."""
    rows = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("ord"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    return V.member_payload(rows, "l_orderkey", "ord", ["flag", "part"])


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS got FROM lineitem GROUP BY 1)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN got IS NULL THEN 'missing' WHEN o_totalprice IS NULL THEN 'extra' WHEN abs(o_totalprice - got) <= 0.5 * greatest(abs(o_totalprice), 1.0) THEN 'right' ELSE 'wrong' END AS verdict FROM orders FULL JOIN s ON l_orderkey = o_orderkey) GROUP BY 1
""")
def gold_verdicts(t: Tables) -> DataFrame:
    """Delivered totals against expected ones: right, wrong, missing, extra."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("got"))
    both = t.orders.select("o_orderkey", "o_totalprice").join(s, "o_orderkey", "full")
    return V.gold_checks(both, "o_totalprice", "got", 0.5).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_returnflag, count(*) AS runs, min(l_quantity) AS low, max(l_quantity) AS high, min(l_quantity) = max(l_quantity) AS stable FROM lineitem GROUP BY 1, 2")
def run_spread(t: Tables) -> DataFrame:
    """How one figure differs between runs."""
    return V.spread(t.lineitem, ["l_suppkey", "l_returnflag"], "l_quantity")


@query("SELECT o_custkey, bool_or(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority = '1-URGENT' END) AS employed, bool_or(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice > 400000 END) AS student FROM orders GROUP BY 1")
def disclosures(t: Tables) -> DataFrame:
    """Disclosures of several documents folded: true over false over unknown."""
    rows = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "1-URGENT").alias("employed"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") > 400_000).alias("student"))
    return V.folded(rows, ["o_custkey"], ["employed", "student"])


_ENT = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&amp;', '&')"


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(" + _ENT.format("html") + r", '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS text_md5 FROM pages")
def sanitized_pages(t: Tables) -> DataFrame:
    """Page text with entities decoded and blanks collapsed, lines kept, by digest."""
    return t.pages.select("page_id", F.md5(P.sanitized(F.col("html"))).alias("text_md5"))


@query("SELECT p_partkey, nullif(trim(p_name), '') AS name, CASE WHEN length(p_type) < 2 THEN NULL ELSE p_type END AS kind FROM part")
def scrubbed_values(t: Tables) -> DataFrame:
    """Values without markup: tags and entities around a name go, one-character values stay."""
    tagged = F.concat(F.lit("<td>&nbsp;"), F.col("p_name"), F.lit("</td>"))
    return t.part.select("p_partkey", F.get(P.scrubbed(F.array(tagged)), F.lit(0)).alias("name"), P.clean_value(F.col("p_type")).alias("kind"))


@query("""
SELECT o_orderkey, count(*) FILTER (l_returnflag <> 'A') >= 6 AND count(*) FILTER (l_returnflag = 'A') = 0 AS unread, list_sort(list_distinct(list(l_returnflag))) = ['N', 'R'] AS both FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def form_marks(t: Tables) -> DataFrame:
    """Choices that a reader left unmarked, and the codes of flags printed as JSON, plain or in objects."""
    mark = F.when(F.col("l_returnflag") == "A", "[x] yes").otherwise("[ ] no")
    flag = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('"'))).otherwise(F.concat(F.lit('{"code":"'), F.col("l_returnflag"), F.lit('"}')))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), mark.alias("mark"), flag.alias("flag"))
    page = lines.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.array_join(F.collect_list("mark"), "\n").alias("text"), F.concat(F.lit("["), F.array_join(F.collect_list("flag"), ","), F.lit("]")).alias("flags"))
    return page.select("o_orderkey", P.marks_unread(F.col("text")).alias("unread"), (P.flag_codes(F.col("flags")) == F.array(F.lit("N"), F.lit("R"))).alias("both"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1e6 >= 0.03 AND l_quantity < l_extendedprice * 0.006 AS lost FROM lineitem
""")
def content_loss(t: Tables) -> DataFrame:
    """Pages with ink but little text."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", P.content_lost(F.col("l_extendedprice"), F.lit(1e6), F.col("l_quantity")).alias("lost"))


@query(r"""
WITH w AS (SELECT source, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT source, len(list_filter(w, lambda x: (regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[#$%&*|<>]')) OR (length(x) >= 4 AND regexp_matches(x, '^[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+$'))))::DOUBLE / len(w) AS s FROM w WHERE len(w) >= 40)
SELECT source, count(*) AS judged, count(*) FILTER (s >= 0.12) AS garbled, count(*) FILTER (s >= 0.12) >= 2 AND count(*) FILTER (s >= 0.12)::DOUBLE / count(*) >= 0.25 AS scanner FROM s GROUP BY 1
""")
def scanner_files(t: Tables) -> DataFrame:
    """Files whose text layers, taken together, read as a scanner's: two pages and a quarter of those judged are garbled."""
    s = t.documents.select("source", P.garble_share(F.col("text")).alias("s")).filter("s is not null")
    counts = s.groupBy("source").agg(F.count("*").alias("judged"), F.count(F.when(F.col("s") >= 0.12, 1)).alias("garbled"))
    return counts.withColumn("scanner", (F.col("garbled") >= 2) & (F.col("garbled") / F.col("judged") >= 0.25))
