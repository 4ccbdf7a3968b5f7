"""Retrieval plan and rule gate. Rules are a bounded catalogue, so they are tested inside the question's
row: no join of questions with rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import let
from ..functions.patterns import contains_all, contains_any, literal_array
from ..functions.text import normalise, normalise_literal
from ..lookups.norms import DEFAULT_DOMAIN, ROUTING
from ..lookups.rules import EFFECTS, GATE_RULES, GateRule


def route_plan(profiles: DataFrame, routing: dict[str, list[str]] = ROUTING) -> DataFrame:
    """Document types to search and rows per layer: profiles ``(query_id, dominios array<string>)``."""
    table = F.create_map(*[x for domain, types in routing.items() for x in (F.lit(domain), literal_array(types))])
    domains = F.when(F.size("dominios") > 0, F.col("dominios")).otherwise(literal_array([DEFAULT_DOMAIN]))
    types = F.array_distinct(F.flatten(F.transform(domains, lambda x: F.coalesce(table[x], literal_array([])))))
    n = F.size(domains)
    total = F.least(F.when(n == 1, 8).otherwise(12) + n * 2, F.lit(20))
    per_layer = F.ceil(total / 2).cast("int")
    return profiles.select(
        "query_id", types.alias("tipos"), F.array(per_layer, per_layer).alias("por_capa"), domains.alias("dominios_activos"),
        F.lit(True).alias("solo_vigentes"))


def _rules(rules: Sequence[GateRule]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(no).alias("n"), F.lit(r.rule_id).alias("rule_id"), literal_array(r.terms).alias("terms"),
            literal_array([normalise_literal(x) for x in r.terms]).alias("required"),
            literal_array([normalise_literal(x) for x in r.exceptions]).alias("barred"),
            literal_array(r.forced).alias("forced"), F.lit(r.effect).alias("effect"),
            F.lit(EFFECTS[r.effect][0]).alias("strength"), F.lit(EFFECTS[r.effect][1]).alias("label"))
        for no, r in enumerate(rules)])


def with_active_rules(questions: DataFrame, rules: Sequence[GateRule] = GATE_RULES) -> DataFrame:
    """Questions with the array ``active`` of the rules they trigger, in catalogue order."""
    def triggered(text: Column) -> Column:
        return F.filter(_rules(rules), lambda r: contains_all(text, r["required"]) & ~contains_any(text, r["barred"]))

    return questions.withColumn("active", let(normalise(F.col("texto")), triggered))


def rule_gate(questions: DataFrame, rules: Sequence[GateRule] = GATE_RULES) -> DataFrame:
    """One row per question and active rule."""
    return with_active_rules(questions, rules).select("query_id", F.explode("active").alias("r")).select(
        "query_id", "r.rule_id", "r.effect", "r.terms", "r.forced")


def forced_norms(questions: DataFrame, rules: Sequence[GateRule] = GATE_RULES) -> DataFrame:
    """Document keys the active rules of each question demand."""
    keys = F.array_distinct(F.flatten(F.transform("active", lambda r: r["forced"])))
    return with_active_rules(questions, rules).select("query_id", F.explode(keys).alias("norm_key"))


def cache_bypass(questions: DataFrame, facts: DataFrame, rules: Sequence[GateRule] = GATE_RULES) -> DataFrame:
    """Whether a question must not be served from the cache."""
    ruled = with_active_rules(questions, rules).select("query_id", (F.size("active") > 0).alias("rule_active"))
    return ruled.join(facts.select("query_id", "sobre_obra_recepcionada"), "query_id", "left").select(
        "query_id", (F.col("rule_active") | F.coalesce("sobre_obra_recepcionada", F.lit(False))).alias("bypass"))


def rule_effect_rollup(questions: DataFrame, rules: Sequence[GateRule] = GATE_RULES) -> DataFrame:
    """Strongest effect of each question and the numbered list of its active rules."""
    lines = F.transform("active", lambda r, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] "), r["label"], F.lit(" "), r["rule_id"], F.lit(": "),
        F.array_join(r["terms"], " + "), F.lit(" -> "), F.array_join(r["forced"], ", ")))
    strongest = F.array_max(F.transform("active", lambda r: F.struct(r["strength"], r["effect"].alias("effect"))))
    return with_active_rules(questions, rules).where(F.size("active") > 0).select(
        "query_id", strongest["effect"].alias("efecto"), F.size("active").alias("reglas"),
        F.array_join(lines, "\n").alias("detalle"))
