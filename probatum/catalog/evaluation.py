"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lookups.patterns import CITED_LONG, CITED_SHORT, TRANSIENT_ERRORS
from ..operators import evaluation as ops, tagging
from . import derived as d
from .fusion import FRAMES, _vec_sql, vector_list
from .registry import query
from .tagging import ERROR_SQL, error_log, sql_marker

EXPECTED = ["PROCEDE", "asesoría jurídica", "aviso legal", "Impedimento", "artículo 4 bis"]
FORBIDDEN = ["sí, es posible", "no existe", "xyz"]
ARTICLES = ["3", "900", "4 BIS", "12", "5.1"]


def cases(t):
    i = F.col("query_id")
    return d.answers(t).select(
        i.alias("case_id"), "respuesta", F.when(i % 13 == 0, F.lit("timeout")).alias("error"), (i % 6).cast("int").alias("fuentes"),
        F.array(d.pick(EXPECTED, i), d.pick(EXPECTED, i + 1)).alias("esperadas"), F.when(i % 4 != 1, F.array(d.pick(FORBIDDEN, i))).alias("prohibidas"),
        F.when(i % 5 != 2, F.array(d.pick(ARTICLES, i))).alias("articulos"), F.when(i % 3 == 0, 2).alias("min_fuentes"), (i * 37 % 5000).alias("latencia_ms"),
        F.concat(F.lit("2026-04-1"), (F.col("conv_id") % 4).cast("string")).alias("fecha"))


def _holds(p: str) -> str:
    return f"contains(lower(respuesta), lower({p}))"


CASES = {
    "cases": f"""
SELECT query_id AS case_id, respuesta, CASE WHEN query_id % 13 = 0 THEN 'timeout' END AS error, query_id % 6 AS fuentes,
  [{d.sql_pick(EXPECTED, 'query_id')}, {d.sql_pick(EXPECTED, 'query_id + 1')}] AS esperadas, CASE WHEN query_id % 4 <> 1 THEN [{d.sql_pick(FORBIDDEN, 'query_id')}] END AS prohibidas,
  CASE WHEN query_id % 5 <> 2 THEN [{d.sql_pick(ARTICLES, 'query_id')}] END AS articulos, CASE WHEN query_id % 3 = 0 THEN 2 END AS min_fuentes, query_id * 37 % 5000 AS latencia_ms,
  '2026-04-1' || (conv_id % 4) AS fecha FROM answers""",
    "checked": f"""
SELECT *, list_filter(esperadas, lambda p: {_holds('p')}) AS encontradas, list_filter(esperadas, lambda p: NOT {_holds('p')}) AS faltantes,
  list_filter(coalesce(prohibidas, []), lambda p: {_holds('p')}) AS prohibidas_encontradas,
  list_transform(list_concat(regexp_extract_all(respuesta, '(?i){CITED_LONG}', 1), regexp_extract_all(respuesta, '(?i){CITED_SHORT}', 1)),
    lambda a: lower(regexp_replace(trim(a), '\\s+', ' ', 'g'))) AS citados FROM cases""",
    "results": """
SELECT *, error IS NULL AND len(faltantes) = 0 AND len(prohibidas_encontradas) = 0 AND len(articulos_faltantes) = 0
  AND fuentes >= coalesce(min_fuentes, 0) AND length(respuesta) > 50 AS pasa FROM (
  SELECT *, list_filter(coalesce(articulos, []), lambda e: len(list_filter(citados, lambda c: contains(c, lower(e)))) = 0) AS articulos_faltantes FROM checked)""",
}


def joined(df, *names):
    for name in names:
        df = df.withColumn(name, F.array_join(F.array_sort(name), "|"))
    return df


@query("phrase_check", d.with_("answers", """
SELECT case_id, array_to_string(list_sort(encontradas), '|') AS encontradas, array_to_string(list_sort(faltantes), '|') AS faltantes,
  array_to_string(prohibidas_encontradas, '|') AS prohibidas_encontradas FROM checked""", CASES))
def phrase_check(t):
    return joined(ops.phrase_check(cases(t)), "encontradas", "faltantes", "prohibidas_encontradas").select(
        "case_id", "encontradas", "faltantes", "prohibidas_encontradas")


@query("cited_articles", d.with_("answers", """
SELECT case_id, array_to_string(list_sort(list_distinct(citados)), '|') AS citados FROM checked""", CASES))
def cited_articles(t):
    return joined(cases(t).select("case_id", ops.cited_articles(F.col("respuesta")).alias("citados")), "citados")


@query("missing_articles", d.with_("answers", """
SELECT case_id, array_to_string(articulos_faltantes, '|') AS faltantes FROM results""", CASES))
def missing_articles(t):
    missing = ops.missing_articles(F.coalesce("articulos", F.array().cast("array<string>")), ops.cited_articles(F.col("respuesta")))
    return joined(cases(t).select("case_id", missing.alias("faltantes")), "faltantes")


@query("eval_pass", d.with_("answers", "SELECT case_id, pasa FROM results", CASES))
def eval_pass(t):
    return ops.eval_pass(cases(t)).select("case_id", "pasa")


@query("eval_summary", d.with_("answers", """
SELECT fecha, count(*) AS total, count(*) FILTER (pasa) AS pasados, count(*) FILTER (NOT pasa) AS fallados,
  CAST(round(avg(latencia_ms)) AS BIGINT) AS latencia_media FROM results GROUP BY fecha""", CASES))
def eval_summary(t):
    return ops.eval_summary(ops.eval_pass(cases(t)))


@query("eval_history", d.with_("answers", """
SELECT case_id, fecha, pasa, CASE WHEN prev IS NULL THEN 'first' WHEN prev = pasa THEN 'same' WHEN pasa THEN 'fixed' ELSE 'broken' END AS cambio
FROM (SELECT *, lag(pasa) OVER (PARTITION BY case_id ORDER BY fecha) AS prev FROM (
  SELECT case_id % 1000 AS case_id, fecha || '-' || (case_id // 1000) AS fecha, pasa FROM results))""", CASES))
def eval_history(t):
    runs = ops.eval_pass(cases(t)).select(
        (F.col("case_id") % 1000).alias("case_id"),
        F.concat("fecha", F.lit("-"), F.floor(F.col("case_id") / 1000).cast("string")).alias("fecha"), "pasa")
    return ops.eval_history(runs)


@query("transient_error", d.with_("", f"SELECT event_id, {sql_marker(TRANSIENT_ERRORS, 'error')} AS reintentar FROM error_log", ERROR_SQL))
def transient_error(t):
    return error_log(t).select("event_id", tagging.transient_error(F.col("error")).alias("reintentar"))


@query("retrieval_recall", d.with_(FRAMES, """
SELECT e.query_id, count(*) AS esperados, count(h.rank) AS encontrados, round(count(h.rank) / count(*), 6) AS recall,
  round(coalesce(1 / min(h.rank), 0), 6) AS rr
FROM (SELECT b.item_id AS query_id, v.vec_id AS item FROM benchmark b JOIN embeddings v ON v.label = b.item_id % 10) e
LEFT JOIN vec h ON h.query_id = e.query_id AND h.chunk_id = e.item GROUP BY e.query_id""", {"vec": _vec_sql(40)}))
def retrieval_recall(t):
    hits = vector_list(t, 40).withColumnRenamed("chunk_id", "item")
    members = t.embeddings.select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("label"))
    expected = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("label")).join(
        members, "label").select("query_id", "item")
    return ops.retrieval_recall(hits, expected, 40)
