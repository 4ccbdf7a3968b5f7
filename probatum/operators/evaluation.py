"""Scoring of answers against expectations.

Cases ``(case_id, respuesta, error, fuentes, esperadas array, prohibidas array, articulos array, min_fuentes,
latencia_ms)``. Phrases and articles per case are short lists kept in the row; a list that is absent is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import UNICODE
from ..lookups.patterns import CITED_LONG, CITED_SHORT


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def phrase_check(cases: DataFrame) -> DataFrame:
    """Expected phrases found and missing, forbidden phrases found, ignoring case."""

    def holds(p: Column) -> Column:
        return F.contains(F.col("lower_answer"), F.lower(p))

    return cases.withColumn("lower_answer", F.lower("respuesta")).select(
        "*", F.filter(_given("esperadas"), holds).alias("encontradas"), F.filter(_given("esperadas"), lambda p: ~holds(p)).alias("faltantes"),
        F.filter(_given("prohibidas"), holds).alias("prohibidas_encontradas")).drop("lower_answer")


def cited_articles(text: Column) -> Column:
    """Distinct articles cited, with their bis/ter suffix, lower case."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(UNICODE + CITED_LONG), F.lit(1)),
        F.regexp_extract_all(text, F.lit(UNICODE + CITED_SHORT), F.lit(1)))
    return F.array_distinct(F.transform(found, lambda a: F.lower(F.regexp_replace(F.trim(a), r"\s+", " "))))


def missing_articles(expected: Column, cited: Column) -> Column:
    """Expected articles that no cited article contains."""
    return F.filter(expected, lambda e: ~F.exists(cited, lambda c: F.contains(c, F.lower(e))))


def eval_pass(cases: DataFrame) -> DataFrame:
    """Every check of a case and whether it passes."""
    checked = phrase_check(cases.withColumn("respuesta", F.coalesce("respuesta", F.lit("")))).withColumn("citados", cited_articles(F.col("respuesta")))
    checked = checked.withColumn("articulos_faltantes", missing_articles(_given("articulos"), F.coalesce("citados", F.array().cast("array<string>"))))
    passed = (
        F.col("error").isNull() & (F.size("faltantes") == 0) & (F.size("prohibidas_encontradas") == 0)
        & (F.size("articulos_faltantes") == 0) & (F.col("fuentes") >= F.coalesce("min_fuentes", F.lit(0)))
        & (F.length("respuesta") > 50))
    return checked.withColumn("pasa", F.coalesce(passed, F.lit(False)))


def eval_summary(results: DataFrame, run: str = "fecha") -> DataFrame:
    """Cases, passes, failures and mean latency of each run."""
    return results.groupBy(run).agg(
        F.count("*").alias("total"), F.count_if("pasa").alias("pasados"), F.count_if(~F.col("pasa")).alias("fallados"),
        F.round(F.avg("latencia_ms")).cast("long").alias("latencia_media"))


def eval_history(results: DataFrame) -> DataFrame:
    """Each case over its runs: whether the outcome flipped since the run before."""
    w = Window.partitionBy("case_id").orderBy("fecha")
    before = F.lag("pasa").over(w)
    change = F.when(before.isNull(), "first").when(before == F.col("pasa"), "same").when(F.col("pasa"), "fixed").otherwise("broken")
    return results.select("case_id", "fecha", "pasa", change.alias("cambio"))


def read_eval_runs(spark, path: str) -> DataFrame:
    """Saved run files: one row per case and run."""
    schema = ("fecha string, baseUrl string, total int, pasados int, fallados int, avgLatenciaMs double, casos array<struct<id:string,"
              "pregunta:string,pasa:boolean,fuentes:int,articulosCitados:array<string>,respuesta:string,latenciaMs:long,error:string>>")
    runs = spark.read.schema(schema).json(path, multiLine=True)
    return runs.select("fecha", F.explode("casos").alias("c")).select(
        "fecha", F.col("c.id").alias("case_id"), "c.pasa", "c.fuentes", "c.respuesta", F.col("c.latenciaMs").alias("latencia_ms"), "c.error")


def retrieval_recall(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Recall at k and reciprocal rank of each query: hits ``(query_id, item, rank)``, expected ``(query_id, item)``."""
    top = hits.where(F.col("rank") <= k).groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    joined = expected.distinct().join(top, ["query_id", "item"], "left")
    return joined.groupBy("query_id").agg(
        F.count("*").alias("esperados"), F.count("rank").alias("encontrados"),
        F.round(F.count("rank") / F.count("*"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("rr"))
