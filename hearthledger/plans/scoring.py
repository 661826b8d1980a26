"""Confidence bound to labels and documents: a document is a record, its label and shape are stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.normalise import nearest
from hearthledger.operators import scoring as K
from hearthledger.plans.registry import Tables, query

_STAGES = """st AS (SELECT d.doc_id, source, stage, score, ceiling FROM (SELECT doc_id, 'extraction' AS stage, 0.85 AS score, NULL::DOUBLE AS ceiling FROM documents UNION ALL SELECT doc_id, 'source', quality::DOUBLE, CASE WHEN quality = 0 THEN 0.49 END FROM labels
  UNION ALL SELECT doc_id, 'business_rule', CASE WHEN n_chars BETWEEN 100 AND 20000 THEN 1.0 ELSE 0.3 END, NULL FROM documents UNION ALL SELECT doc_id, 'finding', 0.15, NULL FROM labels WHERE toxic = 1) s JOIN documents d ON d.doc_id = s.doc_id),
w AS (SELECT *, CASE stage WHEN 'extraction' THEN 0.20 WHEN 'source' THEN 0.30 WHEN 'business_rule' THEN 0.35 ELSE 0.40 END::DOUBLE AS wt FROM st),
f AS (SELECT doc_id, source, least(sum(score::DOUBLE * wt) / sum(wt), coalesce(min(ceiling), 1.0)::DOUBLE, CASE WHEN bool_or(stage = 'source') THEN 1.0 ELSE 0.79 END::DOUBLE) AS composite FROM w GROUP BY 1, 2)"""


def _stages(t: Tables) -> DataFrame:
    docs, labels = t.documents.select("doc_id", "source", "n_chars"), t.labels
    none = F.lit(None).cast("double").alias("ceiling")
    shape = F.when(F.col("n_chars").between(100, 20_000), 1.0).otherwise(0.3).alias("score")
    own = docs.select("doc_id", "source", F.inline(F.array(F.struct(F.lit("extraction").alias("stage"), F.lit(0.85).alias("score")), F.struct(F.lit("business_rule").alias("stage"), shape)))).withColumn("ceiling", F.lit(None).cast("double"))
    source = labels.select("doc_id", F.lit("source").alias("stage"), F.col("quality").cast("double").alias("score"), F.when(F.col("quality") == 0, 0.49).alias("ceiling"))
    disputed = labels.filter("toxic = 1").select("doc_id", F.lit("finding").alias("stage"), F.lit(0.15).alias("score"), none)
    judged = source.unionByName(disputed).join(docs.select("doc_id", "source"), "doc_id")
    return own.unionByName(judged)


@query(f"WITH {_STAGES} SELECT doc_id, source, frac4(composite) AS composite, CASE WHEN composite >= 0.8 THEN 'green' WHEN composite >= 0.5 THEN 'yellow' ELSE 'red' END AS flag FROM f")
def weighted_confidence(t: Tables) -> DataFrame:
    """Field composites from weighted stages, with ceilings and flags."""
    return K.field_scores(_stages(t), ["doc_id", "source"]).withColumn("composite", nearest(F.col("composite"), 4))


@query(f"""
WITH {_STAGES}, o AS (SELECT source, count(*) FILTER (n_chars < 100) AS omissions FROM documents GROUP BY 1), c AS (SELECT source, sum(composite) / count(*) AS mean, count(*) FILTER (composite < 0.5) AS red FROM f GROUP BY 1)
SELECT source, frac4(mean) AS mean, red, omissions, frac4(greatest(0.5, 1 - 0.08::DOUBLE * omissions)) AS coverage FROM c JOIN o USING (source)
""")
def coverage_score(t: Tables) -> DataFrame:
    """Case scores: mean composite, red fields, coverage by omissions."""
    f = K.field_scores(_stages(t), ["doc_id", "source"]).groupBy("source").agg(F.avg("composite").alias("mean"), F.count_if(F.col("composite") < K.YELLOW).alias("red"))
    o = t.documents.groupBy("source").agg(F.count_if(F.col("n_chars") < 100).alias("omissions"))
    return f.join(o, "source").select("source", nearest(F.col("mean"), 4).alias("mean"), "red", "omissions", nearest(K.coverage(F.col("omissions")), 4).alias("coverage"))


@query("""
WITH v AS (SELECT source, quality = 1 AS ok FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) AS n, sum(ok::INT)::BIGINT AS valid, frac4(sum(ok::INT)::DOUBLE / count(*)) AS precision FROM v GROUP BY 1 UNION ALL SELECT '(all)', count(*), sum(ok::INT)::BIGINT, frac4(sum(ok::INT)::DOUBLE / count(*)) FROM v
""")
def reviewer_precision(t: Tables) -> DataFrame:
    """Valid verdicts by source and over all."""
    v = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("source", (F.col("quality") == 1).alias("ok"))
    return K.precision(v, "source", "ok").withColumn("precision", nearest(F.col("precision"), 4))


@query("""
SELECT o_custkey, o_orderpriority, count(*) AS n, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 1.0 ELSE 0.30 END::DOUBLE AS score FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2
""")
def cross_document_agreement(t: Tables) -> DataFrame:
    """Values of one field on two documents and more: agree or conflict."""
    return K.agreement(t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("""
WITH x AS (SELECT source, quality, n_chars FROM labels JOIN documents USING (doc_id))
SELECT source, median(n_chars) FILTER (quality = 1)::DOUBLE AS with_valid, median(n_chars) FILTER (quality = 0)::DOUBLE AS with_invalid FROM x GROUP BY 1
""")
def calibration(t: Tables) -> DataFrame:
    """Median figure of records with a valid and with an invalid verdict."""
    x = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    part = lambda q: F.median(F.when(F.col("quality") == q, F.col("n_chars"))).cast("double")
    return x.groupBy("source").agg(part(1).alias("with_valid"), part(0).alias("with_invalid"))


@query("""
WITH b AS (SELECT s_suppkey, s_acctbal AS was FROM supplier WHERE s_suppkey % 7 <> 0), n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS now FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT coalesce(b.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN n.s_suppkey IS NULL THEN 'gone' WHEN b.s_suppkey IS NULL THEN 'new' ELSE 'changed' END AS change FROM b FULL JOIN n ON b.s_suppkey = n.s_suppkey WHERE was IS DISTINCT FROM now
""")
def snapshot_diff(t: Tables) -> DataFrame:
    """Two snapshots compared null-safely: gone, new, changed."""
    b = t.supplier.filter("s_suppkey % 7 <> 0").select("s_suppkey", F.col("s_acctbal").alias("was"))
    n = t.supplier.filter("s_suppkey % 11 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("now"))
    both = b.join(n, "s_suppkey", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("s_suppkey", F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").otherwise("changed").alias("change"))
