"""Chat histories, requests and message events. Lists stay within one conversation or message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookups.norms import NO_HISTORY

# Accepted modes (the first is the default) and roles.
MODES = ["arquitecto", "abogado", "profundo"]
ROLES = ["user", "assistant"]


def build_history(messages: DataFrame) -> DataFrame:
    """History before the last message of each conversation, as ``ROLE: text`` lines."""
    line = F.concat(F.upper("role"), F.lit(": "), "text")
    packed = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("m"))
    earlier = F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda x: x["line"])
    return packed.select("conv_id", F.when(F.size("m") > 1, F.array_join(earlier, "\n")).otherwise(NO_HISTORY).alias("historial"))


def single_turn_flag(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg((F.count_if(F.col("role") == "user") <= 1).alias("turno_unico"))


def history_filter(messages: DataFrame) -> DataFrame:
    """Messages without those still streaming or failed, roles mapped to user and assistant."""
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    return messages.where(~F.coalesce("streaming", F.lit(False)) & F.col("error").isNull()).select(
        "conv_id", "turn", role.alias("role"), "text")


def validate_request(requests: DataFrame) -> DataFrame:
    """Mode with its default and the first rule a request breaks (null if none)."""
    mode = F.coalesce("modo", F.lit(MODES[0]))
    size = F.length("pregunta")
    error = (
        F.when(F.col("pregunta").isNull() | (size < 5), "pregunta_corta").when(size > 2000, "pregunta_larga")
        .when(~mode.isin(*MODES), "modo_invalido").when(~F.col("role").isin(*ROLES), "rol_invalido"))
    return requests.withColumn("modo", mode).withColumn("error", error)


def source_cards(evidence: DataFrame) -> DataFrame:
    """Result rows as cards: norm label and similarity with three decimals."""
    return evidence.select(
        "query_id", "chunk_id", F.concat_ws(" ", "tipo", "numero").alias("norma"), "articulo",
        F.round("similarity", 3).alias("similarity"), "texto")


def fold_message_events(events: DataFrame) -> DataFrame:
    """One row per answer from its event log ``(msg_id, seq, type, payload)``."""

    def last(kind: str, value: Column) -> Column:
        return F.max(F.when(F.col("type") == kind, F.struct("seq", value.alias("v"))))["v"]

    pieces = F.array_sort(F.collect_list(F.when(F.col("type") == "chunk", F.struct("seq", "payload"))))
    payload = F.col("payload")
    return events.groupBy("msg_id").agg(
        F.array_join(F.transform(pieces, lambda e: e["payload"]), "").alias("texto"),
        last("fuentes", payload.cast("int")).alias("fuentes"), last("meta", payload).alias("meta_id"),
        last("error", payload).alias("error"), F.max(F.col("type") == "done").alias("cerrado"))
