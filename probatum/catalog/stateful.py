"""State-carrying queries. The check SQL of the limiter replays each client's requests one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stateful as ops
from . import derived as d
from .registry import query

DAY_MS = 86_400_000


def requests(t):
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return t.events.select(F.col("user_id").cast("string").alias("client"), "event_id", millis.alias("ts_ms"))


REQUESTS = {"requests": "SELECT CAST(user_id AS VARCHAR) AS client, event_id, epoch_us(ts) // 1000 AS ts_ms FROM events"}
LIMITED = {
    **REQUESTS,
    "numbered": "SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts_ms, event_id) AS i FROM requests",
    "replay": f"""
SELECT client, event_id, ts_ms, i, true AS allowed, [ts_ms] AS held, 4 AS remaining, 0::BIGINT AS reset_ms FROM numbered WHERE i = 1
UNION ALL
SELECT client, event_id, ts_ms, i, len(kept) < 5, CASE WHEN len(kept) < 5 THEN list_append(kept, ts_ms) ELSE kept END,
  CASE WHEN len(kept) < 5 THEN 4 - len(kept) ELSE 0 END, CASE WHEN len(kept) < 5 THEN 0 ELSE kept[1] + {DAY_MS} - ts_ms END
FROM (SELECT n.client, n.event_id, n.ts_ms, n.i, list_filter(r.held, lambda h: h > n.ts_ms - {DAY_MS}) AS kept
      FROM replay r JOIN numbered n ON n.client = r.client AND n.i = r.i + 1)""",
}
LIMIT_SQL = d.with_("", "SELECT client, event_id, allowed, CAST(remaining AS INTEGER) AS remaining, reset_ms FROM replay", LIMITED, recursive=True)


@query("rate_limit", LIMIT_SQL)
def rate_limit(t):
    return ops.rate_limit(requests(t), limit=5, window_ms=DAY_MS)


@query("rate_window_count", d.with_("", f"""
SELECT client, event_id, count(*) OVER (PARTITION BY client ORDER BY ts_ms RANGE BETWEEN {DAY_MS - 1} PRECEDING AND CURRENT ROW) AS en_ventana
FROM requests""", REQUESTS))
def rate_window_count(t):
    return ops.rate_window_count(requests(t), DAY_MS)


@query("client_key", """
SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN '10.0.0.' || user_id WHEN event_id % 4 = 2 THEN 'r-' || user_id ELSE 'unknown' END AS cliente FROM events""")
def client_key(t):
    i, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    forwarded = F.when(i == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 172.16.0.1"))).when(i == 1, F.concat(F.lit("10.0.0."), u))
    return t.events.select("event_id", ops.client_key(forwarded, F.when(i <= 2, F.concat(F.lit("r-"), u))).alias("cliente"))


def sizes(t):
    i = F.col("page_id")
    return t.pages.where(i % 11 != 10).select(i.cast("string").alias("key"), F.when(i % 7 != 0, F.length("html")).alias("size"))


def old_sizes(t):
    i = F.col("page_id")
    return t.pages.where(i % 4 != 0).select(i.cast("string").alias("key"), (F.length("html") - (i % 5) * 200).cast("int").alias("size"))


_SIZES = {
    "sizes": "SELECT CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 7 <> 0 THEN CAST(length(html) AS INTEGER) END AS size FROM pages WHERE page_id % 11 <> 10",
    "old": "SELECT CAST(page_id AS VARCHAR) AS key, CAST(length(html) - (page_id % 5) * 200 AS INTEGER) AS size FROM pages WHERE page_id % 4 <> 0",
}


@query("snapshot_change", d.with_("", """
SELECT coalesce(s.key, o.key) AS key, CASE WHEN s.key IS NULL THEN 'not_checked' WHEN s.size IS NULL THEN 'error' WHEN o.key IS NULL THEN 'baseline'
  WHEN abs(s.size - o.size) > 500 THEN 'changed' ELSE 'unchanged' END AS estado, o.size AS previo, s.size AS actual,
  abs(s.size - o.size) AS delta, coalesce(s.size, o.size) AS nuevo FROM sizes s FULL OUTER JOIN old o ON o.key = s.key""", _SIZES))
def snapshot_change(t):
    return ops.snapshot_change(sizes(t), old_sizes(t))


@query("version_change", """
SELECT CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 3 <> 0 THEN '2024-01-0' || (1 + page_id % 4) END AS previa,
  '2024-01-0' || (1 + page_id % 5) AS version, page_id % 3 <> 0 AND page_id % 4 <> page_id % 5 AS cambio FROM pages""")
def version_change(t):
    i = F.col("page_id")
    key = i.cast("string").alias("key")
    now = t.pages.select(key, F.concat(F.lit("2024-01-0"), (1 + i % 5).cast("string")).alias("version"))
    state = t.pages.where(i % 3 != 0).select(key, F.concat(F.lit("2024-01-0"), (1 + i % 4).cast("string")).alias("version"))
    return ops.version_change(now, state)


@query("hash_change_detect", """
SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'changed' END AS estado, sha256(text) AS hash
FROM documents WHERE doc_id % 3 <> 1""")
def hash_change_detect(t):
    i = F.col("doc_id")
    docs = t.documents.select(i.cast("string").alias("key"), "text")
    state = t.documents.where(i % 3 != 0).select(
        i.cast("string").alias("key"), F.sha2(F.when(i % 3 == 1, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("hash"))
    return ops.hash_change_detect(docs, state).select("key", "estado", "hash")


@query("state_upsert", """
SELECT job, key, value, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (
  SELECT event_type AS job, CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS value, ts AS stamp, event_id FROM events)
QUALIFY row_number() OVER (PARTITION BY job, key ORDER BY stamp DESC, event_id DESC) = 1""")
def state_upsert(t):
    rows = t.events.select(
        F.col("event_type").alias("job"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"),
        F.col("ts").alias("at"), "event_id")
    half = F.col("event_id") % 2 == 0
    merged = ops.state_upsert(rows.where(half), rows.where(~half), ["job", "key"], ["at", "event_id"])
    return merged.select("job", "key", "value", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ops.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
