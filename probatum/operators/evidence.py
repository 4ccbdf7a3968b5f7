"""Checks of answers against their evidence, and texts assembled from it.

Evidence ``(query_id, chunk_id, rank, texto, articulo, tipo, numero, norma)`` comes out of retrieval, which
bounds the passages per query; lists per query stay within that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import UNICODE, any_match
from ..functions.text import strip
from ..lookups import norms as N
from ..lookups.patterns import CITED_FOR_CHECK, DISCLAIMERS, PERMISSIVE
from .tagging import restriction_summary


def has_disclaimer(text: Column) -> Column:
    hit = F.lit(False)
    for phrase in DISCLAIMERS:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def answer_valid(answers: DataFrame) -> DataFrame:
    """Whether an answer is long enough and carries a disclaimer, and why not."""
    text = F.col("respuesta")
    reason = F.when(F.length(strip(text)) < 50, N.TOO_SHORT).when(~has_disclaimer(text), N.NO_DISCLAIMER)
    return answers.withColumn("motivo", reason).withColumn("valida", F.col("motivo").isNull())


def cited_for_check(text: Column) -> Column:
    """Distinct article numbers cited, without ordinal signs and trailing dots."""
    found = F.regexp_extract_all(text, F.lit(UNICODE + CITED_FOR_CHECK), F.lit(1))
    return F.array_distinct(F.filter(
        F.transform(found, lambda a: F.regexp_replace(F.regexp_replace(a, "[°º]", ""), r"\.+$", "")), lambda a: a != ""))


def uncited_articles(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Articles a valid answer cites that its evidence does not hold, with a warning for each."""
    cited = answer_valid(answers).where("valida").select(
        "query_id", F.explode(cited_for_check(F.col("respuesta"))).alias("articulo"))
    held = evidence.where("articulo IS NOT NULL").select(
        "query_id", F.trim(F.regexp_replace("articulo", "[°º]", "")).alias("articulo"))
    text = F.replace(F.lit(N.UNVERIFIED), F.lit("{art}"), F.col("articulo"))
    return cited.join(held, ["query_id", "articulo"], "left_anti").withColumn("advertencia", text)


def check_notes(uncited: DataFrame) -> DataFrame:
    """One note per answer with the number of unverified articles."""
    note = F.replace(F.lit(N.CHECK_NOTE), F.lit("{n}"), F.col("n").cast("string"))
    return uncited.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", "n", note.alias("nota"))


def coherence_check(answers: DataFrame, evidence: DataFrame, shown: int = 3) -> DataFrame:
    """Answers that affirm while their evidence restricts, with the restrictive norms."""
    restricted = restriction_summary(evidence, shown).where("hay_conflicto").select("query_id", "primeros")
    affirming = answers.where(any_match(F.col("respuesta"), PERMISSIVE)).select("query_id")
    norms = F.array_join(F.array_distinct(F.transform("primeros", lambda p: F.concat(
        p["norma"], F.lit(' ("'), p["patron"], F.lit('")')))), "; ")
    clash = affirming.join(restricted, "query_id").select("query_id", norms.alias("normas"))
    return clash.withColumn("advertencia", F.replace(F.lit(N.CONTRADICTION_NOTE), F.lit("{norms}"), F.col("normas")))


def append_notes(answers: DataFrame, notes: DataFrame, clashes: DataFrame) -> DataFrame:
    """Final answer: the text, a disclaimer if it lacks one, the check note, the contradiction note."""
    checked = answer_valid(answers)
    extra = F.when(F.col("motivo") == N.NO_DISCLAIMER, F.lit(N.DISCLAIMER_TEXT)).otherwise("")
    return (
        checked.join(notes.select("query_id", "nota"), "query_id", "left")
        .join(clashes.select("query_id", "advertencia"), "query_id", "left")
        .select("query_id", F.concat("respuesta", extra, F.coalesce("nota", F.lit("")), F.coalesce("advertencia", F.lit("")))
                .alias("final")))


def _listed(rows: DataFrame, line: Column, separator: str, name: str) -> DataFrame:
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return ordered.select("query_id", F.array_join(F.transform("x", lambda e: e["line"]), separator).alias(name))


def _label(prefix: str, value: Column, suffix: str = "") -> Column:
    return F.coalesce(F.concat(F.lit(prefix), F.nullif(value, F.lit("")), F.lit(suffix)), F.lit(""))


def assemble_context(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Numbered source blocks of each query; a fixed text if it has none.

    Optional columns ``jerarquia, vigencia_desde, dominio, organo_emisor, jerarquia_norm, etapas array`` add labels.
    """

    def col(name: str) -> Column:
        return F.col(name) if name in evidence.columns else F.lit(None).cast("string")

    stages = F.array_join("etapas", ", ") if "etapas" in evidence.columns else F.lit(None).cast("string")
    head = F.concat(
        F.lit("--- FUENTE ["), F.col("rank").cast("string"), F.lit("]: "), "norma", _label(" – Art. ", col("articulo")),
        _label(" (", col("jerarquia"), ")"), _label(" [vigente desde ", col("vigencia_desde"), "]"),
        _label(" | Dominio: ", col("dominio")), _label(" | Emisor: ", col("organo_emisor")),
        _label(" | Jerarquía: ", col("jerarquia_norm")), _label(" | Etapas: ", stages), F.lit(" ---\n"), "texto", F.lit("\n---"))
    blocks = _listed(evidence, head, "\n\n", "contexto")
    return queries.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("contexto", F.lit(N.EMPTY_CONTEXT)).alias("contexto"))


def format_relations(relations: DataFrame) -> DataFrame:
    """Relations of each query as lines: ``(query_id, rank, norma_origen, tipo_relacion, norma_destino, articulos)``."""
    arts = F.when(F.size("articulos") > 0, F.concat(F.lit(" (afecta Arts. "), F.array_join("articulos", ", "), F.lit(")"))).otherwise("")
    about = _label(": ", F.col("descripcion")) if "descripcion" in relations.columns else F.lit("")
    line = F.concat(F.lit("- "), "norma_origen", F.lit(" → ["), "tipo_relacion", F.lit("] → "), "norma_destino", arts, about)
    return _listed(relations, line, "\n", "lineas").select(
        "query_id", F.concat(F.lit(N.RELATIONS_HEADER), "lineas").alias("relaciones"))


def format_facts(facts: DataFrame) -> DataFrame:
    """Detected facts of each question as lines; nothing for facts not detected."""

    def fact(label: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"- **{label}**: "), F.replace(value, F.lit("_"), F.lit(" "))))

    received = F.when(F.col("sobre_obra_recepcionada"), F.lit(
        "- ⚠️ **Obra ya recepcionada**: la acción se realiza sobre una edificación con recepción definitiva — implica "
        "requisitos distintos al permiso original."))
    named = F.when(F.col("norma_mencionada").isNotNull(),
                   F.concat(F.lit("- **Norma referenciada en la consulta**: "), "norma_mencionada"))
    lines = F.array_compact(F.array(
        fact("Acción solicitada", F.col("accion"), ~F.col("accion").isin("consultar_normativa", "otro")),
        fact("Estado de la obra", F.col("estado_obra"), F.col("estado_obra") != "desconocido"),
        fact("Tipo de zona", F.col("zona"), F.col("zona") != "desconocida"), received, named))
    text = F.concat(F.lit("\nCONTEXTO FÁCTICO DETECTADO EN LA CONSULTA (confianza: "), "confianza", F.lit("):\n"),
                    F.array_join(lines, "\n"), F.lit("\n"))
    return facts.select("query_id", F.when(F.size(lines) > 0, text).otherwise("").alias("hechos"))


def chunk_digest(evidence: DataFrame, width: int = 100) -> DataFrame:
    """Short digest of a query's passages: norm, article and the opening of the text."""
    line = F.concat("norma", _label(" - Art. ", F.col("articulo")), F.lit(": "), F.substring("texto", 1, width))
    return _listed(evidence, line, "\n", "resumen")
