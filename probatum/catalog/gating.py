"""Routing and rule gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalise_literal
from ..lookups.norms import ROUTING
from ..lookups.rules import EFFECTS, GATE_RULES
from ..operators import conversation, gating as ops, tagging, vectors
from . import derived as d
from .registry import query
from .tagging import FACTS, sql_normalise


def profiles(t):
    """Domains of each question: none to three, by number."""
    i = F.col("query_id")
    domains = F.slice(F.array(*[d.pick(d.DOMAINS, i * k + k) for k in (1, 5, 7)]), F.lit(1), (i % 4).cast("int"))
    return d.questions(t).select("query_id", F.array_distinct(domains).alias("dominios"))


_ROUTING = "CASE x " + " ".join(f"WHEN '{k}' THEN {d.sql_list(v)}" for k, v in ROUTING.items()) + " END"
_DOMAINS = "[" + ", ".join(d.sql_pick(d.DOMAINS, f"query_id * {k} + {k}") for k in (1, 5, 7)) + "]"


@query("route_plan", d.with_("questions", """
SELECT p.query_id, array_to_string(t.tipos, ',') AS tipos, CAST(ceil(least(CASE WHEN n = 1 THEN 8 ELSE 12 END + n * 2, 20) / 2) AS INTEGER) AS por_capa,
  array_to_string(dominios, ',') AS dominios_activos, true AS solo_vigentes
FROM (SELECT *, len(dominios) AS n FROM active) p JOIN (
  SELECT query_id, list(tipo ORDER BY first) AS tipos FROM (
    SELECT query_id, tipo, min(n * 100 + k) AS first FROM (
      SELECT query_id, n, unnest(ts) AS tipo, generate_subscripts(ts, 1) AS k FROM routed) GROUP BY query_id, tipo) GROUP BY query_id) t
ON t.query_id = p.query_id""", {
    "profiles": f"SELECT query_id, ({_DOMAINS})[1:query_id % 4] AS raw FROM questions",
    "firsts": """SELECT query_id, list(x ORDER BY i) AS dominios FROM (
  SELECT query_id, x, min(i) AS i FROM (SELECT query_id, unnest(raw) AS x, generate_subscripts(raw, 1) AS i FROM profiles) GROUP BY query_id, x)
  GROUP BY query_id""",
    "active": "SELECT q.query_id, coalesce(f.dominios, ['construccion']) AS dominios FROM questions q LEFT JOIN firsts f ON f.query_id = q.query_id",
    "routed": f"""SELECT query_id, n, {_ROUTING} AS ts FROM (
  SELECT query_id, unnest(dominios) AS x, generate_subscripts(dominios, 1) AS n FROM active)"""}))
def route_plan(t):
    plan = ops.route_plan(profiles(t))
    return plan.select(
        "query_id", F.array_join("tipos", ",").alias("tipos"), F.get("por_capa", F.lit(0)).alias("por_capa"),
        F.array_join("dominios_activos", ",").alias("dominios_activos"), "solo_vigentes")


RULES = {
    "rules": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{r.rule_id}', {d.sql_list(r.terms)}, {d.sql_list([normalise_literal(x) for x in r.terms])}, "
        f"{d.sql_list([normalise_literal(x) for x in r.exceptions])}::VARCHAR[], {d.sql_list(r.forced)}, '{r.effect}', {EFFECTS[r.effect][0]}, '{EFFECTS[r.effect][1]}')"
        for i, r in enumerate(GATE_RULES)) + ") AS r(n, rule_id, terms, required, barred, forced, effect, strength, label)",
    "normal": f"SELECT query_id, {sql_normalise('texto')} AS texto FROM questions",
    "gate": """
SELECT q.query_id, r.* FROM normal q JOIN rules r ON len(list_filter(r.required, lambda x: NOT contains(q.texto, x))) = 0
 AND len(list_filter(r.barred, lambda x: contains(q.texto, x))) = 0""",
}


@query("rule_gate", d.with_("questions", """
SELECT query_id, rule_id, effect, array_to_string(terms, '+') AS terms, array_to_string(forced, '+') AS forced FROM gate""", RULES))
def rule_gate(t):
    return ops.rule_gate(d.questions(t)).withColumn("terms", F.array_join("terms", "+")).withColumn(
        "forced", F.array_join("forced", "+"))


@query("forced_norms", d.with_("questions", "SELECT DISTINCT query_id, unnest(forced) AS norm_key FROM gate", RULES))
def forced_norms(t):
    return ops.forced_norms(d.questions(t))


@query("cache_bypass", d.with_("questions", """
SELECT q.query_id, q.query_id IN (SELECT query_id FROM gate) OR f.sobre_obra_recepcionada AS bypass
FROM questions q JOIN facts f ON f.query_id = q.query_id""", {**FACTS, **RULES}))
def cache_bypass(t):
    q = d.questions(t)
    return ops.cache_bypass(q, tagging.extract_facts(q))


@query("rule_effect_rollup", d.with_("questions", """
SELECT query_id, max_by(effect, strength) AS efecto, CAST(count(*) AS INTEGER) AS reglas,
  string_agg('[' || i || '] ' || label || ' ' || rule_id || ': ' || array_to_string(terms, ' + ') || ' -> ' || array_to_string(forced, ', '),
             chr(10) ORDER BY i) AS detalle
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS i FROM gate) GROUP BY query_id""", RULES))
def rule_effect_rollup(t):
    return ops.rule_effect_rollup(d.questions(t))


@query("cache_admission", d.with_("questions answers", """
SELECT q.query_id, left(q.texto, 500) AS cached_query, a.respuesta AS answer FROM questions q JOIN answers a ON a.query_id = q.query_id + 1
WHERE length(a.respuesta) > 100 AND (SELECT count(*) FROM conversations c WHERE c.conv_id = q.conv_id AND c.role = 'user') <= 1
  AND q.query_id NOT IN (SELECT query_id FROM gate)""", RULES))
def cache_admission(t):
    q = d.questions(t)
    ruled = ops.with_active_rules(q).select("query_id", "conv_id", "texto", (F.size("active") > 0).alias("rule_active"))
    replies = d.answers(t).select((F.col("query_id") - 1).alias("query_id"), F.col("respuesta").alias("answer"))
    rows = ruled.join(replies, "query_id").join(conversation.single_turn_flag(t.conversations), "conv_id").select(
        "query_id", F.col("texto").alias("query_text"), "answer", F.col("turno_unico").alias("single_turn"), "rule_active")
    return vectors.cache_admission(rows)
