"""Usage and corpus figures. The log is ``(id, user_id, modo, modelo, latencia_ms, feedback, created_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookups.norms import FLAT_LIMIT, PLAN_LIMITS, SUBSCRIPTION_LIMITS, UNLIMITED
from .ranking import top_per


def corpus_stats(norms: DataFrame, chunks: DataFrame) -> DataFrame:
    """Valid documents per type, with the totals of valid documents and of chunks on each row."""
    valid = norms.where("vigente")
    return valid.groupBy("tipo").agg(F.count("*").alias("documentos")).select(
        "tipo", "documentos", valid.select(F.count("*")).scalar().alias("total_vigentes"),
        chunks.select(F.count("*")).scalar().alias("total_chunks"))


def corpus_status(norms: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with its number of chunks (null if it has none)."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return norms.join(counts, "doc_id", "left").select("doc_id", "tipo", "numero", "vigente", "chunks")


def month_usage(users: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """Users with the number of their queries in the month of ``as_of``."""
    month = F.date_trunc("month", as_of)
    used = log.where(F.date_trunc("month", "created_at") == month).groupBy("user_id").agg(F.count("*").alias("n"))
    return users.join(used, "user_id", "left").withColumn("usadas", F.coalesce("n", F.lit(0))).drop("n")


def plan_limit(plan: Column) -> Column:
    chain = F
    for name, limit in PLAN_LIMITS.items():
        chain = chain.when(plan == name, F.lit(UNLIMITED if limit is None else limit))
    return chain.otherwise(F.lit(PLAN_LIMITS["free"]))


def monthly_usage(users: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """Queries this month against the plan's limit, as a percentage with one decimal."""
    used = month_usage(users, log, as_of).withColumn("limite", plan_limit(F.col("plan")))
    return used.select("user_id", "plan", "usadas", "limite",
                       F.round(F.try_divide(F.col("usadas") * 100, F.col("limite")), 1).alias("porcentaje"))


def quota_check(users: DataFrame, log: DataFrame, subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """Whether a user may still ask this month under each of the three quota schemes.

    subscriptions ``(user_id, plan_id, status, period_end)``, one row per user.
    """
    active = subscriptions.where((F.col("status") == "active") & (F.col("period_end").isNull() | (F.col("period_end") > as_of)))
    used = month_usage(users, log, as_of).join(active.select("user_id", "plan_id"), "user_id", "left")
    by_plan = (F.col("plan") == "admin") | (F.col("usadas") < plan_limit(F.col("plan")))
    paid = F.when(F.col("plan_id") == "pro", SUBSCRIPTION_LIMITS["pro"]).otherwise(SUBSCRIPTION_LIMITS["free"])
    return used.select("user_id", "usadas", by_plan.alias("por_plan"), (F.col("usadas") < FLAT_LIMIT).alias("por_limite_unico"),
                       (F.col("usadas") < paid).alias("por_suscripcion"))


def count_by(log: DataFrame, column: str) -> DataFrame:
    """Rows per category with their share in percent; null categories are skipped."""
    counts = log.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = log.select(F.count(column)).scalar()
    return counts.withColumn("porcentaje", F.round(F.col("n") * 100 / total, 1))


def latency_summary(log: DataFrame, last: int = 500) -> DataFrame:
    """Mean, maximum and 90th percentile of the most recent latencies, zeros dropped.

    The percentile is the element at ``floor(n * 0.9)`` of the sorted list.
    """
    recent = log.where("latencia_ms IS NOT NULL").orderBy(F.desc("created_at"), F.desc("id")).limit(last).where("latencia_ms > 0")
    packed = recent.agg(F.sort_array(F.collect_list("latencia_ms")).alias("v"))
    n = F.size("v")
    return packed.select(
        n.alias("n"), F.round(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x) / n).cast("long").alias("media"),
        F.array_max("v").alias("maximo"), F.get("v", F.floor(n * 0.9).cast("int")).alias("p90"))


SKETCH_K = 800
"""Width of a latency sketch: ranks are off by less than 0.5 % of the rows in 99 of 100 sketches, for at most some 20 KB each."""


def latency_sketches(log: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch of the latencies per day and mode: ``(dia, modo, sketch)``.

    Rows without a latency, and zeros, count as in ``latency_summary``: not at all. Days or modes without others have no row.
    """
    timed = log.where("latencia_ms > 0").withColumn("dia", F.to_date("created_at"))
    return timed.groupBy("dia", "modo").agg(F.kll_sketch_agg_bigint(F.col("latencia_ms").cast("long"), k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups; what was sketched is not read again."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """One row per group and rank: the group's columns, ``n``, ``cuantil`` and the estimated ``latencia_ms``."""
    group = [c for c in sketches.columns if c != "sketch"]
    found = [F.struct(F.lit(r).alias("cuantil"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).alias("latencia_ms")) for r in ranks]
    return sketches.select(*group, F.kll_sketch_get_n_bigint("sketch").alias("n"), F.explode(F.array(*found)).alias("q")).select(
        *group, "n", "q.cuantil", "q.latencia_ms")


def rank_error(log: DataFrame, estimates: DataFrame, by: str) -> DataFrame:
    """Estimates with ``desvio``: how far, as a share of the group's rows, each lies from the rank that was asked for.

    An estimate that several rows share covers a span of ranks; inside it the error is 0.
    """
    value, rank = F.col("latencia_ms"), F.col("cuantil")
    ranked = log.where("latencia_ms > 0").select(F.col(by).alias("_group"), F.col("latencia_ms").alias("_value")).groupBy("_group", "_value").agg(
        F.count("*").alias("_rows"))
    pairs = estimates.join(ranked, F.col(by).eqNullSafe(F.col("_group")))
    below = F.sum(F.when(F.col("_value") < value, F.col("_rows")).otherwise(0)) / F.first("n")
    upto = F.sum(F.when(F.col("_value") <= value, F.col("_rows")).otherwise(0)) / F.first("n")
    return pairs.groupBy(by, "n", "cuantil", "latencia_ms").agg(below.alias("_below"), upto.alias("_upto")).select(
        by, "n", "cuantil", "latencia_ms", F.greatest(F.col("_below") - rank, rank - F.col("_upto"), F.lit(0.0)).alias("desvio"))


def feedback_rate(log: DataFrame) -> DataFrame:
    """Thumbs up and down with their share of all rated queries."""
    counts = log.agg(F.count_if("feedback").alias("arriba"), F.count_if(~F.col("feedback")).alias("abajo"))
    total = F.col("arriba") + F.col("abajo")

    def share(name: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(name) * 100, total)), F.lit(0.0)).cast("int")

    return counts.select("arriba", "abajo", total.alias("total"), share("arriba").alias("pct_arriba"), share("abajo").alias("pct_abajo"))


def queries_per_day(log: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Queries of each of the last days, with the bar length relative to the busiest."""
    recent = log.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    daily = recent.groupBy(F.to_date("created_at").alias("dia")).agg(F.count("*").alias("n"))
    top = daily.select(F.max("n")).scalar()
    return daily.select(F.col("dia").cast("string").alias("dia"), "n", F.round(F.col("n") * 100 / top, 1).alias("barra"))


def latest_queries(log: DataFrame, overall: int = 15, per_user: int = 10) -> DataFrame:
    """The most recent queries overall and of each user."""
    order = [F.desc("created_at"), F.desc("id")]
    newest = log.select("id", "user_id", "created_at").orderBy(*order).limit(overall)
    each = top_per(log.select("id", "user_id", "created_at"), ["user_id"], order, per_user).drop("rank")
    return newest.withColumn("ambito", F.lit("global")).unionByName(each.withColumn("ambito", F.lit("usuario")))


def latest_ingested(norms: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """The newest documents, with the total of chunks on each row."""
    newest = norms.orderBy(F.desc("created_at"), F.desc("doc_id")).limit(n)
    return newest.select("doc_id", "tipo", "numero", chunks.select(F.count("*")).scalar().alias("total_chunks"))


def chunks_used_explode(log: DataFrame) -> DataFrame:
    """How often each norm was served as evidence, with its mean similarity."""
    used = log.select(F.explode("chunks_usados").alias("c"))
    return used.groupBy("c.norma").agg(F.count("*").alias("usos"), F.round(F.avg("c.similarity"), 6).alias("similitud_media"))


def type_facets(norms: DataFrame) -> DataFrame:
    """Documents per type and for all types."""
    return norms.rollup("tipo").agg(F.count("*").alias("n")).select(F.coalesce("tipo", F.lit("todos")).alias("tipo"), "n")


def usage_band(usage: DataFrame) -> DataFrame:
    """Percentage capped at 100 and its colour band; unlimited plans have none."""
    pct = F.least(F.round(F.try_divide(F.col("usadas") * 100, F.col("limite"))), F.lit(100.0)).cast("int")
    unlimited = F.col("limite") >= UNLIMITED
    return usage.select(
        "user_id", unlimited.alias("ilimitado"), F.when(~unlimited, pct).alias("porcentaje"),
        F.when(unlimited, "ilimitado").when(pct > 90, "rojo").when(pct > 70, "ambar").otherwise("verde").alias("banda"))
