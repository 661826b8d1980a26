"""Keyed state bound to the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthledger.operators import state as S
from hearthledger.plans.registry import Tables, query


def _events(t: Tables, *more: str) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts", "event_type", *more)


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events GROUP BY 1")
def latest_state(t: Tables) -> DataFrame:
    """The last event of each user is their state."""
    return S.latest(_events(t), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("state"), _text("ts"))


@query("""
WITH r AS (SELECT *, coalesce(sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events)
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place FROM r WHERE event_type = 'signup') WHERE place = 1
""")
def owned_dedupe(t: Tables) -> DataFrame:
    """Claims (signup) accepted only when the last one has ended (purchase or error)."""
    kind = F.col("event_type")
    return S.accepted_claims(_events(t), "user_id", ["ts", "event_id"], kind == "signup", kind.isin("purchase", "error")).select("user_id", "event_id")


@query("""
SELECT event_id, user_id, event_type, gap_us FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS gap_us FROM events) WHERE gap_us <= 7200000000
""")
def repeat_guard(t: Tables) -> DataFrame:
    """The same user and type again within two hours."""
    return S.repeats(_events(t), ["user_id", "event_type"], "ts", ["ts", "event_id"], 7200).select("event_id", "user_id", "event_type", "gap_us")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1800 SECOND")
def watchdog(t: Tables) -> DataFrame:
    """Users silent for more than 1800 seconds as of a given moment."""
    return S.silent(t.events, "user_id", "ts", F.expr("timestamp_ntz '2024-01-30 12:00:00'"), 1800).select("user_id", _text("last"))


@query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY 1, 2
""")
def heartbeat_sessions(t: Tables) -> DataFrame:
    """Sessions of events with gaps below half an hour."""
    return S.sessions(_events(t), "user_id", "ts", ["ts", "event_id"], 1800).select("user_id", "session", _text("start"), _text("end"), "n")


@query("SELECT event_type, ts < TIMESTAMP '2024-01-16 00:00:00' AS expired, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS value FROM events GROUP BY 1, 2")
def retention_split(t: Tables) -> DataFrame:
    """What a retention of fourteen days before a given day removes and keeps."""
    expired = F.col("ts") < F.expr("timestamp_ntz '2024-01-16 00:00:00'")
    return t.events.groupBy("event_type", expired.alias("expired")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))


@query("SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(t: Tables) -> DataFrame:
    """A property of the JSON column by type."""
    return t.events.groupBy("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS verdict, count(*) AS received FROM events GROUP BY 1, 2")
def feedback_replace(t: Tables) -> DataFrame:
    """Verdicts replaced by key: the last write of each (user, type) wins."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    return t.events.groupBy("user_id", "event_type").agg(last.alias("verdict"), F.count("*").alias("received"))


@query("""
SELECT p.event_id, p.user_id, v.value AS as_of FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN LATERAL
  (SELECT value FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts AND v.value IS NOT NULL ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON TRUE
""")
def asof_rate(t: Tables) -> DataFrame:
    """The last viewed value at or before each purchase."""
    e = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    return S.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), "user_id", "ts", "event_id", "value").select("event_id", "user_id", "as_of")


@query("""
WITH RECURSIVE d AS MATERIALIZED (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2),
n AS MATERIALIZED (SELECT f.user_id, f.ts, f.next_ts, d.event_id AS next_id FROM (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ts FROM d) f JOIN d ON d.user_id = f.user_id AND d.ts = f.next_ts),
r AS (SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1 UNION ALL SELECT n.user_id, n.next_ts, n.next_id FROM r JOIN n ON n.user_id = r.user_id AND n.ts = r.ts)
SELECT user_id, event_id FROM r
""")
def throttled_beats(t: Tables) -> DataFrame:
    """Events as heartbeats, one let through in three hours: the clock runs from the last one let through."""
    return S.throttled(_events(t), "user_id", "ts", "event_id", 10_800).select("user_id", "event_id")


@query("""
SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT - l_quantity::BIGINT + 1 AS first, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS last FROM lineitem
""")
def packet_spans(t: Tables) -> DataFrame:
    """First and last page of each attachment of a packet, by running page counts."""
    n = F.col("l_quantity").cast("long")
    last = F.sum(n).over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", (last - n + 1).alias("first"), last.alias("last"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS last, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT - l_quantity::BIGINT + 1 AS first FROM lineitem),
p AS (SELECT o_orderkey, o_orderkey % 40 + 1 AS page FROM orders)
SELECT o_orderkey, page, l_linenumber AS document FROM p LEFT JOIN s ON l_orderkey = o_orderkey AND page BETWEEN first AND last
""")
def page_to_document(t: Tables) -> DataFrame:
    """The attachment that holds a page: a range condition within the packet's key."""
    n = F.col("l_quantity").cast("long")
    last = F.sum(n).over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    spans = t.lineitem.select("l_orderkey", "l_linenumber", (last - n + 1).alias("first"), last.alias("last"))
    asked = t.orders.select("o_orderkey", (F.col("o_orderkey") % 40 + 1).alias("page"))
    hit = (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("page").between(F.col("first"), F.col("last"))
    return asked.join(spans, hit, "left").select("o_orderkey", "page", F.col("l_linenumber").alias("document"))
