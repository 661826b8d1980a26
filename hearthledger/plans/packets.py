"""Packet sources and payload sinks bound to parts, events, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.plans.registry import Tables, query
from hearthledger.sources import packets as S


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'tiff' END AS kind FROM part
""")
def sniff_kind(t: Tables) -> DataFrame:
    """Kinds of files from their first bytes."""
    heads = F.array(*map(F.lit, ("255044462D312E37", "89504E470D0A1A0A", "FFD8FFE000104A46", "49492A0008000000", "504B030414000600")))
    content = F.unhex(F.element_at(heads, (F.col("p_partkey") % 5 + 1).cast("int")))
    return t.part.select("p_partkey", S.sniff_kind(content).alias("kind"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'C' || user_id END AS case_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS program, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN 'extra' ELSE '' END AS unknown FROM events
""")
def parse_requests(t: Tables) -> DataFrame:
    """Request bodies to columns; unknown keys are named, broken bodies give nulls."""
    known = F.to_json(F.struct(F.concat(F.lit("C"), F.col("user_id")).alias("caseId"), F.col("event_type").alias("fundingProgram")))
    more = F.to_json(F.struct(F.concat(F.lit("C"), F.col("user_id")).alias("caseId"), F.col("event_type").alias("fundingProgram"), F.col("value").alias("extra")))
    body = F.when(F.col("event_id") % 4 == 3, "{broken").when(F.col("event_id") % 4 == 1, more).otherwise(known)
    r = t.events.select("event_id", S.parse_request(body).alias("r"))
    return r.select("event_id", F.col("r.caseId").alias("case_id"), F.col("r.fundingProgram").alias("program"), F.when(F.col("r.unknown").isNotNull() & F.col("r.caseId").isNotNull(), F.array_join("r.unknown", ",")).alias("unknown"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, (o_totalprice::DECIMAL(18,2) * 100)::BIGINT AS size FROM orders),
r AS (SELECT *, sum(size) OVER (ORDER BY day DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM o)
SELECT o_orderkey, date_diff('day', day, DATE '2001-09-01') <= 900 AND running <= (SELECT sum(size) // 4 FROM o) AS keep FROM r
""")
def packet_retention(t: Tables) -> DataFrame:
    """Packets kept by age, then by total size from the newest."""
    files = t.orders.select(F.format_string("%020d", "o_orderkey").alias("path"), "o_orderkey", (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").alias("size"), F.col("o_orderdate").cast("date").alias("modified"))
    cap = files.agg(F.floor(F.sum("size") / 4).cast("long")).first()[0] or 0
    kept = S.retained(files.select("path", "size", "modified"), 900, cap, F.lit("2001-09-01").cast("date"))
    return kept.select(F.col("path").cast("long").alias("o_orderkey"), "keep")


@query("""
SELECT c_custkey, to_json({'ref': 'm' || c_custkey, 'records': list({'key': o_orderkey, 'type': o_orderpriority} ORDER BY o_orderkey)})::VARCHAR AS payload FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def case_payload(t: Tables) -> DataFrame:
    """One nested JSON document per case, records in order."""
    records = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("type")))).alias("records"))
    joined = t.customer.select("c_custkey").join(records, "c_custkey")
    return joined.select("c_custkey", F.to_json(F.struct(F.concat(F.lit("m"), F.col("c_custkey")).alias("ref"), "records")).alias("payload"))
