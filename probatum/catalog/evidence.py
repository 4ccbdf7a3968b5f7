"""Answer checks and assembled texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lookups import norms as N
from ..lookups.patterns import CITED_FOR_CHECK, PERMISSIVE
from ..operators import evidence as ops, tagging
from . import derived as d
from .graph import ENRICHED, enriched
from .registry import query
from .tagging import FACTS, tagged_sql


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_bounded(regex: str) -> str:
    """A pattern with word ends, for an engine whose word ends ignore accented letters."""
    return "(?i)(^|[^\\p{L}\\p{N}_])(" + regex.replace("\\b", "") + ")($|[^\\p{L}\\p{N}_])"


_VALID = f"""
SELECT *, CASE WHEN length(trim(respuesta)) < 50 THEN '{N.TOO_SHORT}'
  WHEN NOT (contains(respuesta, 'Aviso legal') OR contains(respuesta, 'asesoría jurídica') OR contains(respuesta, 'profesional habilitado'))
  THEN '{N.NO_DISCLAIMER}' END AS motivo FROM replies"""
_REPLIES = """
SELECT query_id, conv_id, CASE WHEN query_id % 5 = 0 THEN right(respuesta, 30)
  WHEN query_id % 5 = 1 THEN replace(replace(replace(respuesta, 'Aviso legal', 'Aviso'), 'asesoría jurídica', 'ayuda'), 'habilitado', 'x')
  ELSE respuesta END AS respuesta FROM answers"""


def replies(t):
    """Answers, some of them too short and some without their disclaimer."""
    r = F.col("respuesta")
    bare = F.replace(F.replace(F.replace(r, F.lit("Aviso legal"), F.lit("Aviso")), F.lit("asesoría jurídica"), F.lit("ayuda")),
                     F.lit("habilitado"), F.lit("x"))
    i = F.col("query_id") % 5
    return d.answers(t).withColumn("respuesta", F.when(i == 0, F.right(r, F.lit(30))).when(i == 1, bare).otherwise(r))


CHECK = {
    "replies": _REPLIES,
    "valid": _VALID,
    "cited": f"""
SELECT DISTINCT query_id, regexp_replace(regexp_replace(a, '[°º]', '', 'g'), '\\.+$', '') AS articulo FROM (
  SELECT query_id, unnest(regexp_extract_all(respuesta, '(?i){CITED_FOR_CHECK}', 1)) AS a FROM valid WHERE motivo IS NULL)""",
    "uncited": f"""
SELECT query_id, articulo, replace({sql_text(N.UNVERIFIED)}, '{{art}}', articulo) AS advertencia FROM cited c
WHERE articulo <> '' AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.query_id = c.query_id AND e.articulo = c.articulo)""",
    "notes": f"""
SELECT query_id, count(*) AS n, replace({sql_text(N.CHECK_NOTE)}, '{{n}}', CAST(count(*) AS VARCHAR)) AS nota FROM uncited GROUP BY query_id""",
    "tagged": tagged_sql("evidence"),
    "clashes": f"""
SELECT query_id, normas, replace({sql_text(N.CONTRADICTION_NOTE)}, '{{norms}}', normas) AS advertencia FROM (
  SELECT query_id, string_agg(entry, '; ' ORDER BY n) AS normas FROM (
    SELECT query_id, entry, min(n) AS n FROM (
      SELECT query_id, norma || ' ("' || patron || '")' AS entry, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n
      FROM tagged WHERE etiqueta = 'restrictivo') WHERE n <= 3 GROUP BY query_id, entry) GROUP BY query_id)
WHERE query_id IN (SELECT query_id FROM replies WHERE {" OR ".join(f"regexp_matches(respuesta, '{sql_bounded(p)}')" for p in PERMISSIVE)})""",
}


@query("answer_valid", d.with_("answers", "SELECT query_id, motivo, motivo IS NULL AS valida FROM valid", {k: CHECK[k] for k in ("replies", "valid")}))
def answer_valid(t):
    return ops.answer_valid(replies(t)).select("query_id", "motivo", "valida")


@query("uncited_articles", d.with_("evidence", "SELECT * FROM uncited", {k: CHECK[k] for k in ("replies", "valid", "cited", "uncited")}))
def uncited_articles(t):
    return ops.uncited_articles(replies(t), d.evidence(t))


@query("coherence_check", d.with_("evidence", "SELECT * FROM clashes", CHECK))
def coherence_check(t):
    return ops.coherence_check(replies(t), d.evidence(t))


@query("append_notes", d.with_("evidence", f"""
SELECT v.query_id, respuesta || CASE WHEN motivo = '{N.NO_DISCLAIMER}' THEN {sql_text(N.DISCLAIMER_TEXT)} ELSE '' END
  || coalesce(n.nota, '') || coalesce(c.advertencia, '') AS final
FROM valid v LEFT JOIN notes n ON n.query_id = v.query_id LEFT JOIN clashes c ON c.query_id = v.query_id""", CHECK))
def append_notes(t):
    r, e = replies(t), d.evidence(t)
    return ops.append_notes(r, ops.check_notes(ops.uncited_articles(r, e)), ops.coherence_check(r, e))


@query("assemble_context", d.with_("evidence questions", f"""
SELECT q.query_id, coalesce(string_agg('--- FUENTE [' || e.rank || ']: ' || e.norma || coalesce(' – Art. ' || e.articulo, '') || ' | Dominio: '
  || n.dominio || ' | Emisor: ' || n.organo_emisor || ' | Jerarquía: ' || n.jerarquia_norm || ' ---' || chr(10) || e.texto || chr(10) || '---',
  chr(10) || chr(10) ORDER BY e.rank), {sql_text(N.EMPTY_CONTEXT)}) AS contexto
FROM (SELECT query_id FROM questions UNION ALL SELECT query_id FROM answers) q LEFT JOIN evidence e ON e.query_id = q.query_id
LEFT JOIN norms n ON n.numero = e.numero GROUP BY q.query_id"""))
def assemble_context(t):
    n = d.norms(t).select("numero", "dominio", "organo_emisor", "jerarquia_norm")
    asked = d.questions(t).select("query_id").union(d.answers(t).select("query_id"))
    return ops.assemble_context(asked, d.evidence(t).join(n, "numero"))


@query("format_relations", d.with_("evidence", f"""
SELECT query_id, {sql_text(N.RELATIONS_HEADER)} || string_agg('- ' || norma_origen || ' → [' || tipo_relacion || '] → ' || norma_destino ||
  CASE WHEN articulos <> '' THEN ' (afecta Arts. ' || articulos || ')' ELSE '' END, chr(10) ORDER BY rank) AS relaciones
FROM enriched GROUP BY query_id""", ENRICHED))
def format_relations(t):
    return ops.format_relations(enriched(t))


_LINES = """
CASE WHEN accion NOT IN ('consultar_normativa', 'otro') THEN '- **Acción solicitada**: ' || replace(accion, '_', ' ') END,
CASE WHEN estado_obra <> 'desconocido' THEN '- **Estado de la obra**: ' || replace(estado_obra, '_', ' ') END,
CASE WHEN zona <> 'desconocida' THEN '- **Tipo de zona**: ' || replace(zona, '_', ' ') END,
CASE WHEN sobre_obra_recepcionada THEN '- ⚠️ **Obra ya recepcionada**: la acción se realiza sobre una edificación con recepción definitiva — implica requisitos distintos al permiso original.' END,
CASE WHEN norma_mencionada IS NOT NULL THEN '- **Norma referenciada en la consulta**: ' || norma_mencionada END"""


@query("format_facts", d.with_("questions", f"""
SELECT query_id, CASE WHEN l = '' THEN '' ELSE chr(10) || 'CONTEXTO FÁCTICO DETECTADO EN LA CONSULTA (confianza: ' || confianza || '):' || chr(10) || l || chr(10) END AS hechos
FROM (SELECT *, concat_ws(chr(10), {_LINES}) AS l FROM facts)""", FACTS))
def format_facts(t):
    return ops.format_facts(tagging.extract_facts(d.questions(t)))


@query("chunk_digest", d.with_("evidence", """
SELECT query_id, string_agg(norma || coalesce(' - Art. ' || articulo, '') || ': ' || left(texto, 100), chr(10) ORDER BY rank) AS resumen
FROM evidence GROUP BY query_id"""))
def chunk_digest(t):
    return ops.chunk_digest(d.evidence(t))
