"""Case rules bound to customers (cases), their orders (documents, declarations) and lines (records)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions import pagetext as P
from hearthledger.functions.normalise import nearest
from hearthledger.operators import case_rules as C
from hearthledger.operators import review as V
from hearthledger.plans import reconciling
from hearthledger.plans.registry import ORACLE, Tables, query

#: Topics of the questionnaire, the documents that prove them, and the finding without one. Bound to part types and names.
TOPICS = [
    ("1-URGENT", "small|economy", "QUESTIONNAIRE_EMPLOYMENT_UNVERIFIED"), ("2-HIGH", "ring|gear", "QUESTIONNAIRE_CHECKING_UNVERIFIED"), ("3-MEDIUM", "^hot ", "QUESTIONNAIRE_PENSION_UNVERIFIED"),
    ("4-NOT SPECIFIED", "blue|red", "QUESTIONNAIRE_STUDENT_UNVERIFIED"), ("5-LOW", "never printed", "QUESTIONNAIRE_SSA_UNVERIFIED"),
]
_TOPICS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TOPICS)


@query(f"""
WITH r(topic, pattern, code) AS (VALUES {_TOPICS}), y AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS topic FROM orders WHERE o_orderstatus <> 'F'),
d AS (SELECT DISTINCT o_custkey AS c, lower(p_name || ' ' || p_type) AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT y.c AS "case", code FROM y JOIN r USING (topic) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.c = y.c AND regexp_matches(d.label, r.pattern))
""")
def unverified_disclosures(t: Tables) -> DataFrame:
    """Topics answered yes without a document that proves them."""
    disclosed = t.orders.select(F.col("o_custkey").alias("case"), F.col("o_orderpriority").alias("topic"), (F.col("o_orderstatus") != "F").alias("yes"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    labels = t.orders.select("o_orderkey", F.col("o_custkey").alias("case")).join(lines, "o_orderkey").join(t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label")), "p_partkey")
    return C.unverified_disclosures(disclosed, labels.select("case", "label"), t.spark.createDataFrame(TOPICS, "topic string, pattern string, code string"))


@query("""
WITH f AS (SELECT c_custkey, unnest(['c_name', 'c_mktsegment', 'balance', 'phone']) AS field, unnest([c_name, CASE WHEN c_nationkey = 3 THEN '  ' ELSE c_mktsegment END, CASE WHEN c_acctbal >= 0 THEN c_acctbal::VARCHAR END, NULL]) AS v FROM customer)
SELECT c_custkey, field FROM f WHERE v IS NULL OR trim(v) = ''
""")
def required_gaps(t: Tables) -> DataFrame:
    """Required cells that a record leaves empty."""
    rows = t.customer.select("c_custkey", "c_name", F.when(F.col("c_nationkey") == 3, "  ").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.lit(None).cast("string").alias("phone"))
    return C.value_gaps(rows, "c_custkey", ["c_name", "c_mktsegment", "balance", "phone"])


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS c, round(l_extendedprice * CASE WHEN l_linestatus = 'F' THEN 100 ELSE 1 END / 100, 2)::DECIMAL(18,2) AS v FROM lineitem),
r AS (SELECT l_orderkey AS c, l_orderkey * 8 + l_linenumber AS id, max(l_extendedprice)::DECIMAL(18,2) AS v FROM lineitem GROUP BY 1, 2)
SELECT id, CASE WHEN k.c IS NOT NULL THEN r.v::DOUBLE END AS amount, k.c IS NOT NULL AS printed FROM r LEFT JOIN (SELECT DISTINCT l_orderkey AS c, l_extendedprice::DECIMAL(18,2) AS v FROM lineitem WHERE l_linestatus = 'F') k ON k.c = r.c AND k.v = r.v
""")
def amount_provenance(t: Tables) -> DataFrame:
    """Amounts of records that a page of their case prints, in any of their forms; the others become null."""
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)).otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    pages = t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("case"), F.concat(F.lit("paid $"), shown, F.lit(" net.")).alias("text"))
    records = t.lineitem.groupBy(F.col("l_orderkey").alias("case"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(F.max("l_extendedprice").alias("amount"))
    return C.provenance(records, pages, "id", "amount")


@query("""
WITH n AS (SELECT p_partkey, p_brand, p_name FROM part WHERE p_size <= 2), r AS (SELECT p_brand, p_name, min(p_partkey) AS ord FROM n GROUP BY 1, 2), a AS (SELECT p_partkey AS ref, p_brand, p_name FROM part)
SELECT a.ref, r.p_name AS member FROM a LEFT JOIN r ON r.p_brand = a.p_brand AND r.p_name = a.p_name WHERE EXISTS (SELECT 1 FROM r x WHERE x.p_brand = a.p_brand AND x.p_name = a.p_name)
""")
def resolved_members(t: Tables) -> DataFrame:
    """Names resolved to the roster's most similar one; the twin checks those that the roster prints alike."""
    roster = t.part.filter("p_size <= 2").groupBy(F.col("p_brand").alias("case"), F.col("p_name").alias("member")).agg(F.min("p_partkey").alias("ord"))
    found = C.resolved_names(t.part.select(F.col("p_brand").alias("case"), F.col("p_partkey").alias("ref"), F.col("p_name").alias("name")), roster)
    return found.join(t.part.select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("case"), F.col("p_name").alias("member")).join(roster.select("case", "member"), ["case", "member"], "left_semi").select("ref"), "ref", "left_semi")


@query("""
WITH m AS (SELECT p_partkey AS m_id, p_brand AS c, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind FROM part), f AS (SELECT p_brand AS c, p_name AS name, p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN p_type END AS kind FROM part WHERE p_size < 40),
e AS (SELECT c, name, arg_min(kind, ord) FILTER (kind IS NOT NULL) AS kind FROM f GROUP BY 1, 2)
SELECT m.c AS "case", m.m_id, coalesce(m.kind, e.kind) AS kind FROM m LEFT JOIN e ON e.c = m.c AND e.name = m.name
""")
def filled_members(t: Tables) -> DataFrame:
    """Empty fields of members filled from documents that name them."""
    members = t.part.select(F.col("p_brand").alias("case"), F.col("p_partkey").alias("m_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"))
    found = t.part.filter("p_size < 40").select(F.col("p_brand").alias("case"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("kind"))
    return C.filled_members(members, found, ["kind"])


@query("""
WITH d AS (SELECT l_orderkey AS c, l_linenumber * 100000000 + l_partkey AS page, CASE WHEN l_returnflag = 'A' THEN l_shipdate::DATE END AS day, l_extendedprice FROM lineitem),
u AS (SELECT c, page, max(day) AS day FROM d GROUP BY 1, 2), k AS (SELECT *, last_value(day IGNORE NULLS) OVER (PARTITION BY c ORDER BY page ROWS UNBOUNDED PRECEDING) AS d FROM u),
n AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN lag(d) OVER w IS NULL OR d = lag(d) OVER w THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY c ORDER BY page)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY c ORDER BY page ROWS UNBOUNDED PRECEDING) AS part FROM n)
SELECT c AS "case", part::BIGINT AS part, min(page) AS first, max(page) AS last, count(*) AS n FROM s GROUP BY 1, 2
""")
def split_groups(t: Tables) -> DataFrame:
    """Certification groups split where the effective date changes."""
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("case"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("page")).agg(F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate").cast("date"))).alias("day"))
    return C.split_groups(pages)


@query("""
WITH r AS (SELECT l_orderkey AS page, l_linenumber - 1 AS turn, max(l_discount * 10) AS score, bool_or(l_returnflag = 'A') AS clean FROM lineitem GROUP BY 1, 2),
u AS (SELECT page, score AS s, clean AS c FROM r WHERE turn = 0), b AS (SELECT page, arg_max(turn, (score, -turn)) AS turn, max(score) AS score, arg_max(clean, (score, -turn)) AS clean FROM r WHERE turn <> 0 GROUP BY 1)
SELECT u.page, CASE WHEN b.score >= s + 0.1 OR (b.clean AND NOT c AND b.score >= s - 0.05) THEN b.turn ELSE 0 END AS turn FROM u LEFT JOIN b USING (page)
""")
def rotation_winners(t: Tables) -> DataFrame:
    """The reading of a page, upright or turned, that wins."""
    reads = t.lineitem.groupBy(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") - 1).alias("turn")).agg(F.max(F.col("l_discount") * 10).alias("score"), F.bool_or(F.col("l_returnflag") == "A").alias("clean"))
    return C.rotation_winner(reads)


@query("""
SELECT doc_id, trim(text) = '' OR lang = 'es' OR (source = 'src1' AND lang <> 'fr') AS skipped FROM documents
""")
def skipped_pages(t: Tables) -> DataFrame:
    """Pages that say nothing: empty, blank, or of low quality and not repaired."""
    flag = lambda on, name: F.when(on, name)
    flags = F.filter(F.array(flag(F.col("lang") == "es", "blank"), flag(F.col("source") == "src1", "low_quality"), flag(F.col("lang") == "fr", "repaired")), lambda x: x.isNotNull())
    return t.documents.select("doc_id", C.skipped_page(F.col("text"), flags).alias("skipped"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders")
def month_keys(t: Tables) -> DataFrame:
    """Months printed in several forms, as keys."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM")).when(k == 1, F.date_format(d, "MM/yyyy")).when(k == 2, F.date_format(d, "M/d/yyyy")).when(k == 3, F.date_format(d, "MMMM yyyy")).otherwise(F.concat(F.lit("week of "), F.date_format(d, "yyyy")))
    return t.orders.select("o_orderkey", C.month_key(shown).alias("month"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, cents(CASE WHEN l_linestatus = 'F' THEN l_quantity * l_suppkey * m ELSE l_quantity * m END) AS annual FROM (SELECT *, (CASE l_returnflag WHEN 'A' THEN 52 WHEN 'N' THEN 26 END) AS m FROM lineitem)")
def record_annuals(t: Tables) -> DataFrame:
    """Yearly figures from rate, hours and pay frequency; unknown without a frequency."""
    m = F.when(F.col("l_returnflag") == "A", 52).when(F.col("l_returnflag") == "N", 26)
    hours = F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", nearest(C.record_annual(F.col("l_quantity"), hours, m)).alias("annual"))


@query("SELECT o_orderkey, 'CERT_TYPE_CONTRADICTS_DOCUMENT' AS code FROM orders JOIN (SELECT o_custkey AS c, min(o_orderdate) AS first FROM orders GROUP BY 1) ON c = o_custkey WHERE o_orderdate = first AND o_orderstatus <> 'F'")
def certification_kinds(t: Tables) -> DataFrame:
    """Certifications effective on the move-in day that state another type."""
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    stated = F.when(F.col("o_orderstatus") == "F", "MI").when(F.col("o_orderstatus") == "O", "AR").otherwise("IR")
    return t.orders.join(first, "o_custkey").select("o_orderkey", C.certification_kind(F.col("first"), F.col("o_orderdate"), stated).alias("code")).filter("code is not null")


@query("""
WITH f AS (SELECT o_custkey AS c, o_orderkey, 'F' || o_orderstatus AS code, 0.15 + length(o_orderpriority) / 100.0 AS strength, CASE WHEN o_orderkey % 10 = 0 THEN [] ELSE [lower(o_orderpriority)] END AS subject FROM orders WHERE o_orderstatus <> 'F'),
k AS (SELECT DISTINCT o_custkey AS c, lower(o_orderpriority) AS w FROM orders), n AS (SELECT c, count(*) AS n FROM k GROUP BY 1)
SELECT c, w, count(*) AS stages, frac4(min(score)) AS lowest FROM (SELECT f.c, k.w, f.strength::DOUBLE AS score FROM f JOIN k ON k.c = f.c WHERE len(subject) > 0 AND list_contains(subject, k.w) UNION ALL SELECT f.c, k.w, (1 - 0.6 / n)::DOUBLE FROM f JOIN k ON k.c = f.c JOIN n ON n.c = f.c WHERE len(subject) = 0) GROUP BY 1, 2
""")
def dispute_shares(t: Tables) -> DataFrame:
    """How findings lower records: those they name by strength, those of the whole case by a share."""
    word = F.lower("o_orderpriority")
    subject = F.when(F.col("o_orderkey") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(word))
    findings = t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("case"), F.concat(F.lit("F"), "o_orderstatus").alias("code"), (0.15 + F.length("o_orderpriority") / 100.0).alias("strength"), subject.alias("subject"))
    cards = t.orders.select(F.col("o_custkey").alias("case"), word.alias("w")).distinct().select("case", F.struct("case", "w").alias("card"), F.array("w").alias("words"))
    return C.dispute_stages(findings, cards).groupBy(F.col("card.case").alias("c"), F.col("card.w").alias("w")).agg(F.count("*").alias("stages"), nearest(F.min("score"), 4).alias("lowest"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = l.l_orderkey AND h.l_returnflag = l.l_returnflag AND h.l_discount > 0.08)")
def current_cards(t: Tables) -> DataFrame:
    """Records whose source has no calculation marked as history."""
    details = F.when(F.col("l_discount") > 0.08, "[historical] ended").otherwise("")
    calcs = t.lineitem.select("l_orderkey", "l_returnflag", details.alias("details"))
    return C.without_historical(t.lineitem, calcs, ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH n AS (SELECT l_suppkey, max(l_shipdate::DATE) AS newest FROM lineitem GROUP BY 1)
SELECT l.l_suppkey, count(*) AS n, '[' || string_agg('{"day":"' || strftime(l_shipdate, '%Y-%m-%d') || '","amount":' || l_quantity::BIGINT || '}', ',' ORDER BY l_shipdate::DATE, l_quantity) || ']' AS stubs
FROM lineitem l JOIN n ON n.l_suppkey = l.l_suppkey WHERE date_diff('day', l_shipdate::DATE, newest) <= 548 GROUP BY 1
""")
def deliverable_stubs(t: Tables) -> DataFrame:
    """Stubs of a record's last 548 days, by date, as JSON."""
    stubs = t.lineitem.select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").cast("long").alias("amount"))
    return C.deliverable_stubs(stubs, ["l_suppkey"])


@query("""
WITH h AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS f FROM orders GROUP BY 1)
SELECT o_custkey AS "case", array_to_string(f, ',') AS forms, array_to_string(list_filter(['1-URGENT', '3-MEDIUM', 'HUD 9887'], lambda x: NOT list_contains(f, x)), ',') AS missing FROM h
""")
def forms_present(t: Tables) -> DataFrame:
    """Forms that a case holds and required ones that it lacks."""
    held = C.forms_present(t.orders.select(F.col("o_custkey").alias("case"), F.col("o_orderpriority").alias("label")), ["1-URGENT", "3-MEDIUM", "HUD 9887"])
    return held.select("case", F.array_join("forms", ",").alias("forms"), F.array_join("missing", ",").alias("missing"))


@query(f"""
SELECT 'INCOME_DECLARED_NOT_VERIFIED' AS code, "case", count(*) AS n FROM ({ORACLE["income_reconciliation"]}) WHERE how = 'declared_only' GROUP BY "case"
UNION ALL SELECT 'INCOME_VERIFIED_NOT_DECLARED', "case", undeclared FROM ({ORACLE["undeclared_income"]}) WHERE undeclared > 0
UNION ALL SELECT 'INCOME_SECOND_DECLARATION', o_custkey, count(*) FROM ({ORACLE["collapsed_declarations"]}) JOIN orders USING (o_orderkey) WHERE kind <> 'different' GROUP BY 2
""")
def reconciliation_findings(t: Tables) -> DataFrame:
    """What reconciliation leaves open, as findings of a case."""
    run = lambda q: q(t.spark, t.sf_dir)
    coded = lambda df, code: df.select(F.lit(code).alias("code"), "case", "n")
    declared = run(reconciling.income_reconciliation).filter("how = 'declared_only'").groupBy("case").agg(F.count("*").alias("n"))
    verified = run(reconciling.undeclared_income).filter("undeclared > 0").select("case", F.col("undeclared").alias("n"))
    second = run(reconciling.collapsed_declarations).filter("kind <> 'different'").join(t.orders.select("o_orderkey", F.col("o_custkey").alias("case")), "o_orderkey").groupBy("case").agg(F.count("*").alias("n"))
    return coded(declared, "INCOME_DECLARED_NOT_VERIFIED").unionByName(coded(verified, "INCOME_VERIFIED_NOT_DECLARED")).unionByName(coded(second, "INCOME_SECOND_DECLARATION"))


@query("""
WITH x AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'Are you a student? [x] yes [ ] no' WHEN turn % 2 = 0 THEN 'Are you a student? Yes No' ELSE 'currently a student' END AS form, role FROM conversations)
SELECT conv_id, turn, role = 'user' OR turn % 2 <> 0 AS indicated FROM x
""")
def indications(t: Tables) -> DataFrame:
    """A keyword with a marked yes, or in prose; a bare question says nothing."""
    form = F.when(F.col("role") == "user", "Are you a student? [x] yes [ ] no").when(F.col("turn") % 2 == 0, "Are you a student? Yes No").otherwise("currently a student")
    return t.conversations.select("conv_id", "turn", V.marked_yes(form, "student").alias("indicated"))


@query("""
SELECT page_id, CASE WHEN contains(lower(substr(html, 1, 300)), 'meta charset') THEN 'meta charset' WHEN contains(lower(substr(html, 1, 300)), '<title>') THEN '<title>' WHEN contains(lower(substr(html, 1, 300)), 'html') THEN 'html' END AS label FROM pages
""")
def printed_titles(t: Tables) -> DataFrame:
    """The longest known label in the head of a page."""
    return t.pages.select("page_id", C.printed_title(F.col("html"), ["html", "<title>", "Meta Charset"]).alias("l")).select("page_id", F.lower("l").alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS torn FROM lineitem")
def broken_numbers(t: Tables) -> DataFrame:
    """Numbers torn apart on pages that print amounts."""
    shown = F.when(F.col("l_returnflag") == "A", "gross $5.00 total 1,2 34.50").otherwise("gross $5.00 total 1,234.50")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.size(P.broken_numbers(shown)).alias("torn"))
