"""Classification bound to documents, pages, conversations and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.operators import classify as C
from hearthledger.plans.registry import Tables, query

_RULES = [("(?i)license", "license"), (r"[A-Za-z0-9]@[A-Za-z0-9]", "contact sheet"), (r"\+[0-9]", "call record"), (r"(?m)\| ", "table"), ("[#$%&*]{3}", "unreadable")]


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN regexp_matches(text, '[A-Za-z0-9]@[A-Za-z0-9]') THEN 'contact sheet' WHEN regexp_matches(text, '\+[0-9]') THEN 'call record' WHEN contains(text, '| ') THEN 'table' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'unreadable' ELSE 'prose' END AS label FROM documents
""")
def label_routing(t: Tables) -> DataFrame:
    """Document labels by the first rule that holds."""
    return t.documents.select("doc_id", C.first_rule(F.col("text"), _RULES, "prose").alias("label"))


@query("""
WITH p AS (SELECT p_partkey, p_type || CASE WHEN p_partkey % 4 = 0 THEN ' (Previous)' ELSE '' END AS l, lower(p_type) AS b FROM part),
a(alias, canonical) AS (SELECT lower(p_type), p_type FROM (SELECT DISTINCT p_type FROM part) WHERE length(p_type) % 2 = 0 UNION SELECT lower(p_type), 'Odd' FROM (SELECT DISTINCT p_type FROM part) WHERE length(p_type) % 3 = 0 AND length(p_type) % 2 = 1)
SELECT p_partkey, l, canonical, CASE WHEN canonical IS NULL THEN 'none' WHEN lower(canonical) = b THEN 'exact' ELSE 'alias' END AS fit FROM p LEFT JOIN a ON b = alias
""")
def canonical_labels(t: Tables) -> DataFrame:
    """Labels with suffix to their canonical form by a broadcast alias table."""
    kinds = t.part.select("p_type").distinct()
    exact = kinds.filter(F.length("p_type") % 2 == 0).select(F.lower("p_type").alias("alias"), F.col("p_type").alias("canonical"))
    other = kinds.filter((F.length("p_type") % 3 == 0) & (F.length("p_type") % 2 == 1)).select(F.lower("p_type").alias("alias"), F.lit("Odd").alias("canonical"))
    rows = t.part.select("p_partkey", F.concat("p_type", F.when(F.col("p_partkey") % 4 == 0, " (Previous)").otherwise("")).alias("l"))
    return C.canonical(rows, "l", exact.union(other))


@query("""
WITH c AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND lag(turn) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, run::BIGINT AS run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY 1, 2, 3
""")
def group_runs(t: Tables) -> DataFrame:
    """Consecutive turns of one role are one group."""
    return C.runs(t.conversations, "conv_id", "turn", "role")


@query("""
SELECT source, lang, count(*) AS pages FROM documents GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1
""")
def majority_label(t: Tables) -> DataFrame:
    """The most frequent label of each case, ties to the first name."""
    counts = t.documents.groupBy("source", "lang").agg(F.count("*").alias("pages"))
    return counts.groupBy("source").agg(F.min_by(F.struct("lang", "pages"), F.struct(-F.col("pages"), F.col("lang"))).alias("b")).select("source", "b.lang", "b.pages")


@query("""
WITH l(label, words) AS (VALUES ('steel box', ['steel', 'box']), ('brushed steel', ['brushed', 'steel']), ('economy', ['economy']), ('promo copper', ['promo', 'copper'])),
p AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part), h AS (SELECT p_partkey, label, len(words) AS size, len(list_intersect(list_distinct(w), words)) AS k FROM p, l),
g AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY k::DOUBLE / size DESC, size DESC, label) AS r FROM h WHERE k > 0 AND k * 2 >= size)
SELECT p_partkey, label FROM g WHERE r = 1
""")
def checklist_match(t: Tables) -> DataFrame:
    """Checklist rows to labels by shared words, half of the label's at least."""
    labels = t.spark.createDataFrame([("steel box", ["steel", "box"]), ("brushed steel", ["brushed", "steel"]), ("economy", ["economy"]), ("promo copper", ["promo", "copper"])], "label string, words array<string>")
    return C.by_shared_words(t.part.select("p_partkey", F.split(F.lower("p_type"), " ").alias("w")), "p_partkey", "w", labels)


@query("""
SELECT conv_id, md5(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) ORDER BY turn)) AS combined, count(*) AS pages FROM conversations GROUP BY 1
""")
def combined_text(t: Tables) -> DataFrame:
    """Pages of a group joined in order under page marks, by digest."""
    page = F.concat(F.lit("--- Page "), F.col("turn").cast("string"), F.lit(" ---\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), page.alias("p"))))
    return t.conversations.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n")).alias("combined"), F.count("*").alias("pages"))


@query("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS current, count(*) - 1 AS superseded FROM orders GROUP BY 1
""")
def promote_latest(t: Tables) -> DataFrame:
    """The certification with the latest effective date is current, the others superseded."""
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current"), (F.count("*") - 1).alias("superseded"))


@query("""
SELECT p_type, count(*) AS parts FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5
""")
def top_labels(t: Tables) -> DataFrame:
    """The five most frequent labels (a top-k report)."""
    return t.part.groupBy("p_type").agg(F.count("*").alias("parts")).orderBy(F.desc("parts"), "p_type").limit(5)
