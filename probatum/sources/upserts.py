"""Keyed changes to tables, as frames of the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stateful import latest_per_key


def upsert_documents(stored: DataFrame, incoming: DataFrame, today: Column) -> DataFrame:
    """Catalogue after an ingest: rows matched by (tipo, numero) take the new title, source, dates and hash and
    become valid; others are added or kept. Columns ``(tipo, numero, titulo, url_fuente, fecha_publicacion,
    hash_contenido, fecha_actualizacion, vigente)``."""
    fresh = incoming.select("tipo", "numero", F.struct("titulo", "url_fuente", "fecha_publicacion", "hash_contenido").alias("n"))
    both = stored.join(fresh, ["tipo", "numero"], "full_outer")
    hit = F.col("n").isNotNull()

    def value(name: str) -> Column:
        return F.when(hit, F.col(f"n.{name}")).otherwise(F.col(name)).alias(name)

    return both.select(
        "tipo", "numero", value("titulo"), value("url_fuente"), value("fecha_publicacion"), value("hash_contenido"),
        F.when(hit, today).otherwise(F.col("fecha_actualizacion")).alias("fecha_actualizacion"),
        (hit | F.col("vigente")).alias("vigente"))


def replace_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunks after an ingest: all chunks of the documents in ``incoming`` replaced, NUL characters removed."""
    clean = incoming.withColumn("texto", F.replace("texto", F.lit("\u0000"), F.lit("")))
    kept = stored.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(clean.select(*kept.columns))


def cascade_delete(norms: DataFrame, chunks: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue and chunks without the removed documents ``(doc_id)``."""
    return norms.join(removed, "doc_id", "left_anti"), chunks.join(removed, "doc_id", "left_anti")


def set_validity(norms: DataFrame, changes: DataFrame, today: Column) -> DataFrame:
    """Catalogue with validity set by ``changes (doc_id, vigente string)``; only the text ``true`` is true."""
    flags = changes.select("doc_id", (F.col("vigente") == "true").alias("flag"))
    joined = norms.join(flags, "doc_id", "left")
    return joined.withColumn("fecha_actualizacion", F.when(F.col("flag").isNotNull(), today).otherwise(
        F.col("fecha_actualizacion"))).withColumn("vigente", F.coalesce("flag", "vigente")).drop("flag")


def query_log_rows(answered: DataFrame, evidence: DataFrame) -> DataFrame:
    """Log rows with the used chunks as an array of ``(id, norma, articulo, similarity)``; optional columns
    (user, classification, ...) pass through when present."""
    used = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.struct(F.col("chunk_id").alias("id"), "norma", "articulo", "similarity").alias("c")))).alias("x"))
    packed = used.select("query_id", F.transform("x", lambda e: e["c"]).alias("chunks_usados"))
    return answered.join(packed, "query_id", "left")


def append_log(rows: DataFrame, path: str, day: str = "created_at") -> None:
    """Append log rows, partitioned by day."""
    rows.withColumn("dia", F.to_date(day)).write.mode("append").partitionBy("dia").parquet(path)


def apply_feedback(log: DataFrame, votes: DataFrame) -> DataFrame:
    """Log with the last vote of each query: 1 is up, -1 is down, anything else is ignored.

    votes ``(id, value, at)``.
    """
    valid = votes.where(F.col("value").isin(1, -1)).select("id", "value", "at")
    last = latest_per_key(valid, ["id"], ["at", "value"]).select("id", (F.col("value") > 0).alias("voto"))
    return log.join(last, "id", "left").withColumn("feedback", F.coalesce("voto", "feedback")).drop("voto")


def subscription_latest(events: DataFrame) -> DataFrame:
    """Subscription of each user after all events ``(event_id, at, user_id, type, status, sub_id, period_end)``.

    A deleted subscription leaves the free plan; only an active one gives the pro plan. Events without a
    user are ignored.
    """
    known = events.where(F.col("user_id").isNotNull() & F.col("type").isin("created", "updated", "deleted"))
    gone = F.col("type") == "deleted"
    rows = known.select(
        "user_id", "at", "event_id", "sub_id", F.when(~gone & (F.col("status") == "active"), "pro").otherwise("free").alias("plan_id"),
        F.when(gone, "canceled").otherwise(F.col("status")).alias("status"), F.when(~gone, F.col("period_end")).alias("period_end"))
    return latest_per_key(rows, ["user_id"], ["at", "event_id"]).drop("at", "event_id")


def profile_from_signup(profiles: DataFrame, signups: DataFrame) -> DataFrame:
    """New profiles of users ``(id, email, metadata json)`` that have none: name from the metadata, else from the address.
    Of several signups of one user the least by address and metadata counts."""
    known = signups.join(profiles.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("email", "metadata")).alias("s"))
    fresh = known.select("id", "s.*")
    name = F.coalesce(F.get_json_object("metadata", "$.nombre"), F.split("email", "@")[0])
    return fresh.select("id", "email", name.alias("nombre"), F.lit("beta").alias("plan"))
