"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversation as ops
from . import derived as d
from .registry import query


@query("build_history", """
SELECT conv_id, CASE WHEN count(*) > 1 THEN coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (turn < last), '') ELSE 'SIN HISTORIAL' END AS historial
FROM (SELECT *, upper(role) || ': ' || text AS line, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id""")
def build_history(t):
    return ops.build_history(t.conversations)


@query("single_turn_flag", "SELECT conv_id, count(*) FILTER (role = 'user') <= 1 AS turno_unico FROM conversations GROUP BY conv_id")
def single_turn_flag(t):
    return ops.single_turn_flag(t.conversations)


@query("history_filter", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations
WHERE turn % 5 <> 4 AND (conv_id + turn) % 7 <> 0""")
def history_filter(t):
    turn = F.col("turn")
    marked = t.conversations.withColumn("streaming", turn % 5 == 4).withColumn(
        "error", F.when((F.col("conv_id") + turn) % 7 == 0, F.lit("x")))
    return ops.history_filter(marked)


@query("validate_request", d.with_("", """
SELECT conv_id, turn, coalesce(modo, 'arquitecto') AS modo, CASE WHEN length(pregunta) < 5 THEN 'pregunta_corta' WHEN length(pregunta) > 2000 THEN 'pregunta_larga'
  WHEN coalesce(modo, 'arquitecto') NOT IN ('arquitecto', 'abogado', 'profundo') THEN 'modo_invalido' WHEN role NOT IN ('user', 'assistant') THEN 'rol_invalido' END AS error
FROM r""", {"r": """
SELECT conv_id, turn, role, CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 'abogado' WHEN 2 THEN 'profundo' WHEN 3 THEN 'otro' ELSE 'arquitecto' END AS modo,
  CASE conv_id % 6 WHEN 0 THEN right(text, 3) WHEN 1 THEN repeat(text, 20) ELSE text END AS pregunta FROM conversations"""}))
def validate_request(t):
    turn, conv = F.col("turn") % 5, F.col("conv_id") % 6
    mode = F.when(turn == 1, "abogado").when(turn == 2, "profundo").when(turn == 3, "otro").when(turn == 4, "arquitecto")
    question = F.when(conv == 0, F.right("text", F.lit(3))).when(conv == 1, F.repeat("text", 20)).otherwise(F.col("text"))
    asked = t.conversations.select("conv_id", "turn", "role", mode.alias("modo"), question.alias("pregunta"))
    return ops.validate_request(asked).select("conv_id", "turn", "modo", "error")


@query("source_cards", d.with_("evidence", """
SELECT query_id, chunk_id, norma, articulo, round(1.0::DOUBLE / rank, 3) AS similarity, texto FROM evidence"""))
def source_cards(t):
    return ops.source_cards(d.evidence(t).withColumn("similarity", F.lit(1.0) / F.col("rank")))


def message_events(t):
    """Answers cut into the events they were sent as."""
    msg = (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id")
    given = t.conversations.where("role = 'assistant'").select(msg, "turn", "conv_id", F.split("text", " ").alias("w"))
    chunks = given.select("msg_id", F.posexplode("w").alias("pos", "x")).select(
        "msg_id", (F.col("pos") + 10).cast("long").alias("seq"), F.lit("chunk").alias("type"),
        F.concat("x", F.lit(" ")).alias("payload"))
    i = F.col("msg_id")
    def event(seq, kind, payload):
        return F.struct(F.lit(seq).cast("long").alias("seq"), kind.alias("type"), payload.alias("payload"))

    end = F.when(i % 5 == 0, F.lit("error")).otherwise(F.lit("done"))
    other = given.select("msg_id", F.explode(F.array(
        event(1, F.lit("fuentes"), (i % 9).cast("string")), event(2, F.lit("fuentes"), (i % 7).cast("string")),
        event(3, F.lit("meta"), F.concat(F.lit("m"), i.cast("string"))), event(1_000_000, end, F.lit("fin")))).alias("e")).select(
        "msg_id", "e.*")
    return chunks.unionByName(other)


@query("fold_message_events", """
SELECT conv_id * 1000 + turn AS msg_id, text || ' ' AS texto, CAST((conv_id * 1000 + turn) % 7 AS INTEGER) AS fuentes, 'm' || (conv_id * 1000 + turn) AS meta_id,
  CASE WHEN (conv_id * 1000 + turn) % 5 = 0 THEN 'fin' END AS error, (conv_id * 1000 + turn) % 5 <> 0 AS cerrado
FROM conversations WHERE role = 'assistant'""")
def fold_message_events(t):
    return ops.fold_message_events(message_events(t))
