"""Usage and corpus figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as ops
from . import derived as d
from .registry import query

PLANS = ["free", "beta", "pro", "admin", "otro"]
MODELS = ["gemini", "deepseek", "llama"]


def log(t):
    """The events as a query log."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("modo"),
        F.when(k % 4 != 0, d.pick(MODELS, k)).alias("modelo"),
        F.when(k % 9 != 0, F.floor("value")).cast("int").alias("latencia_ms"),
        F.when(k % 5 == 1, True).when(k % 5 == 2, False).alias("feedback"), F.col("ts").alias("created_at"), k.alias("k"))


LOG = {"log": f"""
SELECT event_id AS id, user_id, event_type AS modo, CASE WHEN k % 4 <> 0 THEN {d.sql_pick(MODELS, 'k')} END AS modelo,
  CASE WHEN k % 9 <> 0 THEN CAST(floor(value) AS INTEGER) END AS latencia_ms, CASE k % 5 WHEN 1 THEN true WHEN 2 THEN false END AS feedback,
  ts AS created_at, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""}


def users(t):
    i = F.col("c_custkey")
    return t.customer.select(i.alias("user_id"), d.pick(PLANS, i).alias("plan"))


USERS = {"users": f"SELECT c_custkey AS user_id, {d.sql_pick(PLANS, 'c_custkey')} AS plan FROM customer"}


def as_of(t):
    return t.events.select(F.max("ts")).scalar()


@query("corpus_stats", d.with_("norms doc_lines", """
SELECT tipo, count(*) AS documentos, (SELECT count(*) FROM norms WHERE vigente) AS total_vigentes,
  (SELECT count(*) FROM doc_lines) AS total_chunks FROM norms WHERE vigente GROUP BY tipo"""))
def corpus_stats(t):
    return ops.corpus_stats(d.norms(t), d.passages(t))


@query("corpus_status", d.with_("norms doc_lines", """
SELECT n.doc_id, n.tipo, n.numero, n.vigente, c.chunks FROM norms n
LEFT JOIN (SELECT doc_id, count(*) AS chunks FROM doc_lines WHERE doc_id % 5 <> 0 GROUP BY doc_id) c ON c.doc_id = n.doc_id"""))
def corpus_status(t):
    return ops.corpus_status(d.norms(t), d.passages(t).where(F.col("doc_id") % 5 != 0))


USAGE = {**LOG, **USERS, "month": """
SELECT user_id, count(*) AS n FROM log WHERE date_trunc('month', created_at) = (SELECT date_trunc('month', max(ts)) FROM events) GROUP BY user_id""",
         "usage": """
SELECT *, round(usadas * 100 / nullif(limite, 0), 1) AS porcentaje FROM (
  SELECT u.user_id, u.plan, coalesce(m.n, 0) AS usadas, CASE u.plan WHEN 'admin' THEN 999999 WHEN 'pro' THEN 300 WHEN 'beta' THEN 50 ELSE 20 END AS limite
  FROM users u LEFT JOIN month m ON m.user_id = u.user_id)"""}


@query("monthly_usage", d.with_("", "SELECT * FROM usage", USAGE))
def monthly_usage(t):
    return ops.monthly_usage(users(t), log(t), as_of(t))


def subscriptions(t):
    newest = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by(
        F.struct("o_orderstatus", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    status = F.col("o.o_orderstatus")
    return newest.select(
        "user_id", F.when(status == "F", "free").otherwise("pro").alias("plan_id"), F.when(status == "O", "canceled").otherwise("active").alias("status"),
        F.when(status != "P", F.col("o.o_orderdate") + F.expr("INTERVAL 9000 DAYS")).alias("period_end"))


@query("quota_check", d.with_("", """
SELECT u.user_id, usadas, plan = 'admin' OR usadas < limite AS por_plan, usadas < 50 AS por_limite_unico,
  usadas < CASE WHEN s.plan_id = 'pro' THEN 500 ELSE 50 END AS por_suscripcion
FROM usage u LEFT JOIN (SELECT * FROM subs WHERE status = 'active' AND (period_end IS NULL OR period_end > (SELECT max(ts) FROM events))) s
ON s.user_id = u.user_id""", {**USAGE, "subs": """
SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'free' ELSE 'pro' END AS plan_id,
  CASE WHEN o_orderstatus = 'O' THEN 'canceled' ELSE 'active' END AS status,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 9000 DAY END AS period_end
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""}))
def quota_check(t):
    return ops.quota_check(users(t), log(t), subscriptions(t), as_of(t))


for _column, _name in (("modo", "count_by_mode"), ("modelo", "count_by_model")):
    query(_name, d.with_("", f"""
SELECT {_column}, count(*) AS n, round(count(*) * 100 / (SELECT count({_column}) FROM log), 1) AS porcentaje FROM log
WHERE {_column} IS NOT NULL GROUP BY {_column}""", LOG))(lambda t, c=_column: ops.count_by(log(t), c))


@query("latency_summary", d.with_("", """
SELECT CAST(count(*) AS INTEGER) AS n, CAST(round(avg(latencia_ms)) AS BIGINT) AS media, max(latencia_ms) AS maximo,
  list_extract(list_sort(list(latencia_ms)), CAST(floor(count(*) * 0.9) AS BIGINT) + 1) AS p90
FROM (SELECT * FROM log WHERE latencia_ms IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 500) WHERE latencia_ms > 0""", LOG))
def latency_summary(t):
    return ops.latency_summary(log(t))


@query("feedback_rate", d.with_("", """
SELECT a AS arriba, b AS abajo, a + b AS total, CAST(round(a * 100 / (a + b)) AS INTEGER) AS pct_arriba, CAST(round(b * 100 / (a + b)) AS INTEGER) AS pct_abajo
FROM (SELECT count(*) FILTER (feedback) AS a, count(*) FILTER (NOT feedback) AS b FROM log)""", LOG))
def feedback_rate(t):
    return ops.feedback_rate(log(t))


@query("queries_per_day", d.with_("", """
SELECT CAST(dia AS VARCHAR) AS dia, n, round(n * 100 / max(n) OVER (), 1) AS barra FROM (
  SELECT CAST(created_at AS DATE) AS dia, count(*) AS n FROM log WHERE created_at >= (SELECT max(ts) - INTERVAL 14 DAY FROM events) GROUP BY 1)""", LOG))
def queries_per_day(t):
    return ops.queries_per_day(log(t), as_of(t))


@query("latest_queries", d.with_("", """
SELECT id, user_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS creada, ambito FROM (
  (SELECT id, user_id, created_at, 'global' AS ambito FROM log ORDER BY created_at DESC, id DESC LIMIT 15)
  UNION ALL (SELECT id, user_id, created_at, 'usuario' FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 10))""", LOG))
def latest_queries(t):
    return ops.latest_queries(log(t)).select("id", "user_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("creada"), "ambito")


@query("latest_ingested", d.with_("norms doc_lines", """
SELECT doc_id, tipo, numero, (SELECT count(*) FROM doc_lines) AS total_chunks FROM norms ORDER BY (doc_id * 7919) % 10007 DESC, doc_id DESC LIMIT 10"""))
def latest_ingested(t):
    dated = d.norms(t).withColumn("created_at", (F.col("doc_id") * 7919) % 10007)
    return ops.latest_ingested(dated, d.passages(t))


@query("chunks_used_explode", d.with_("", """
SELECT norma, count(*) AS usos, round(avg(similarity), 6) AS similitud_media FROM (
  SELECT 'LGUC ' || ((k * j) % 50) AS norma, 1.0::DOUBLE / j AS similarity FROM (SELECT k, unnest(range(1, k % 4 + 1)) AS j FROM log)) GROUP BY norma""", LOG))
def chunks_used_explode(t):
    k, n = F.col("k"), (F.col("k") % 4).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    used = F.transform(numbers, lambda j: F.struct(
        F.concat(F.lit("LGUC "), ((k * j) % 50).cast("string")).alias("norma"), (F.lit(1.0) / j).alias("similarity")))
    return ops.chunks_used_explode(log(t).select(used.alias("chunks_usados")))


@query("type_facets", d.with_("norms", "SELECT coalesce(tipo, 'todos') AS tipo, count(*) AS n FROM norms GROUP BY ROLLUP (tipo)"))
def type_facets(t):
    return ops.type_facets(d.norms(t))


@query("usage_band", d.with_("", """
SELECT user_id, limite >= 999999 AS ilimitado, CASE WHEN limite < 999999 THEN p END AS porcentaje,
  CASE WHEN limite >= 999999 THEN 'ilimitado' WHEN p > 90 THEN 'rojo' WHEN p > 70 THEN 'ambar' ELSE 'verde' END AS banda
FROM (SELECT *, CAST(least(round(usadas * 100 / limite), 100) AS INTEGER) AS p FROM usage)""", USAGE))
def usage_band(t):
    return ops.usage_band(ops.monthly_usage(users(t), log(t), as_of(t)))
