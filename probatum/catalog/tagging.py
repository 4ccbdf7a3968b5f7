"""Tagging queries. The check SQL matches accent-folded text, that of ``out_of_domain`` text as written; the jobs use Unicode word boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, normalise
from ..lookups import patterns as P
from ..operators import tagging as ops
from . import derived as d
from .registry import query

_FOLD = str.maketrans(ACCENTED, PLAIN)


def folded(regex: str) -> str:
    return "(?i)" + regex.translate(_FOLD).replace("'", "''")


def sql_fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def sql_any(regexes: list[str], x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({sql_fold(x)}, '{folded(r)}')" for r in regexes) + ")"


def sql_label(table: list[tuple[str, str]], x: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({sql_fold(x)}, '{folded(r)}') THEN '{n}'" for n, r in table) + f" ELSE '{default}' END"


def sql_hit(regexes: list[str], x: str) -> str:
    """Matched text of the first pattern that matches, taken from the text as written."""
    f = sql_fold(x)
    return "CASE " + " ".join(
        f"WHEN regexp_matches({f}, '{folded(r)}') THEN substr({x}, instr({f}, regexp_extract({f}, '{folded(r)}')), "
        f"length(regexp_extract({f}, '{folded(r)}')))" for r in regexes) + " END"


@query("domain_crossings", d.with_("questions", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT query_id, {i} AS area_no, '{a}' AS area, '{o}' AS organismo, '{n}' AS norma_probable, {sql_hit(rs, 'lower(texto)')} AS gatillante "
    "FROM questions" for i, (a, o, n, rs) in enumerate(P.CROSSING_AREAS)) + ") WHERE gatillante IS NOT NULL"))
def domain_crossings(t):
    return ops.domain_crossings(d.questions(t))


def sql_any_written(regexes: list[str], x: str) -> str:
    """As the jobs match: the text as written, marks kept, ignoring case, with Unicode word ends."""
    other = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"

    def ended(regex: str) -> str:
        parts = [(p.startswith(r"\b"), p.endswith(r"\b"), p.removeprefix(r"\b").removesuffix(r"\b")) for p in regex.split("|")]
        return "|".join((f"(^|{other})" if first else "") + word + (f"($|{other})" if last else "") for first, last, word in parts)

    return "(" + " OR ".join(f"regexp_matches(translate({x}, 'ıİ', 'ii'), '(?i){ended(r)}')" for r in regexes) + ")"


@query("out_of_domain", d.with_("questions", f"SELECT query_id, {sql_any_written(P.OUT_OF_DOMAIN, 'texto')} AS fuera FROM questions"))
def out_of_domain(t):
    return d.questions(t).select("query_id", ops.out_of_domain(F.col("texto")).alias("fuera"))


FACTS = {
    "hits": f"""
SELECT query_id, {sql_label(P.ACTIONS, 'texto', '')} AS hit_action, {sql_label(P.WORK_STATUS, 'texto', 'desconocido')} AS estado_obra,
  {sql_label(P.ZONES, 'texto', 'desconocida')} AS zona, nullif(trim(regexp_extract(texto, '(?i){P.NAMED_NORM}', 1)), '') AS norma_mencionada,
  {sql_any([P.ASKS_PERMISSION], 'texto')} AS consulta_procedencia FROM questions""",
    "facts": """
SELECT query_id, CASE WHEN hit_action <> '' THEN hit_action WHEN consulta_procedencia THEN 'otro' ELSE 'consultar_normativa' END AS accion,
  estado_obra, zona, norma_mencionada, estado_obra = 'con_recepcion' AND hit_action IN ('ampliar', 'acoger_conjunto_armonico', 'modificar_permiso')
  AS sobre_obra_recepcionada, consulta_procedencia,
  CASE CAST(hit_action <> '' AS INT) + CAST(estado_obra <> 'desconocido' AS INT) + CAST(zona <> 'desconocida' AS INT)
       + CAST(norma_mencionada IS NOT NULL AS INT) WHEN 0 THEN 'baja' WHEN 1 THEN 'media' ELSE 'alta' END AS confianza FROM hits""",
}


@query("extract_facts", d.with_("questions", "SELECT * FROM facts", FACTS))
def extract_facts(t):
    return ops.extract_facts(d.questions(t))


TAGGED = """
SELECT *, CASE WHEN patron IS NOT NULL THEN 'restrictivo' WHEN {exc} THEN 'excepcion' ELSE 'general' END AS etiqueta,
  trim(substr(texto, greatest(pos - 60, 1), pos + length(patron) + 100 - greatest(pos - 60, 1))) AS fragmento
FROM (SELECT *, instr(lower(texto), lower(patron)) AS pos FROM (SELECT *, {hit} AS patron FROM {source}))"""


def tagged_sql(source: str) -> str:
    return TAGGED.format(exc=sql_any(P.EXCEPTIONS, "texto"), hit=sql_hit(P.RESTRICTIVE, "texto"), source=source)


@query("restriction_tagger", d.with_("passages", "SELECT chunk_id, etiqueta, patron, fragmento FROM tagged", {"tagged": tagged_sql("passages")}))
def restriction_tagger(t):
    return ops.restriction_tagger(d.passages(t)).select("chunk_id", "etiqueta", "patron", "fragmento")


SUMMARY = {
    "tagged": tagged_sql("evidence"),
    "first_hits": """
SELECT query_id, string_agg(norma || ':' || patron || ':' || left(fragmento, 250), ' | ' ORDER BY n) AS primeros FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n FROM tagged WHERE etiqueta = 'restrictivo')
WHERE n <= 5 GROUP BY query_id""",
    "summary": """
SELECT t.query_id, count(*) FILTER (etiqueta = 'restrictivo') AS restrictivos, count(*) FILTER (etiqueta = 'excepcion') AS excepciones,
  count(*) FILTER (etiqueta = 'general') AS generales, bool_or(etiqueta = 'restrictivo') AS hay_conflicto, any_value(f.primeros) AS primeros
FROM tagged t LEFT JOIN first_hits f ON f.query_id = t.query_id GROUP BY t.query_id""",
}


@query("restriction_summary", d.with_("evidence", "SELECT * FROM summary", SUMMARY))
def restriction_summary(t):
    shown = F.array_join(F.transform("primeros", lambda p: F.concat_ws(":", p["norma"], p["patron"], p["fragmento"])), " | ")
    return ops.restriction_summary(d.evidence(t)).withColumn("primeros", shown)


_KEYWORDS = ["Art. 1500", "LGUC", "DDU 700", "Artículo 201", "DDU-541", "DFL 458 art 250"]


@query("suspicious_refs", d.with_("questions", f"""
SELECT query_id, count(*) AS sospechosos, max_by(referencia, n) AS referencia FROM (
  SELECT query_id, n, CASE WHEN art > 999 THEN 'Art. ' || art
    WHEN (law OR regexp_matches(fuente, '(?i)LGUC|DFL.?458')) AND art > 200 THEN 'Art. ' || art || ' LGUC'
    WHEN ddu > 600 THEN 'DDU ' || ddu END AS referencia FROM (
    SELECT *, try_cast(regexp_extract(fuente, '(?i){P.REF_ARTICLE}', 1) AS BIGINT) AS art,
           try_cast(regexp_extract(fuente, '(?i){P.REF_CIRCULAR}', 1) AS BIGINT) AS ddu FROM (
      SELECT query_id, regexp_matches(texto, '(?i)LGUC|DFL.?458') AS law, unnest(s) AS fuente, generate_subscripts(s, 1) AS n FROM (
        SELECT query_id, texto, list_concat([{d.sql_pick(_KEYWORDS, 'query_id')}], regexp_extract_all(texto, '(?i){P.REF_ANY}')) AS s
        FROM questions))))
WHERE referencia IS NOT NULL GROUP BY query_id"""))
def suspicious_refs(t):
    asked = d.questions(t).withColumn("keywords", F.array(d.pick(_KEYWORDS, F.col("query_id"))))
    return ops.named_suspicious(ops.suspicious_refs(asked))


def sql_normalise(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_fold(x)}, '[¿?¡!.,;:]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("normalize_text", d.with_("questions", f"SELECT query_id, {sql_normalise('texto')} AS normal FROM questions"))
def normalize_text(t):
    return d.questions(t).select("query_id", normalise(F.col("texto")).alias("normal"))


MARKDOWN = ("\n## Título **fuerte**\n- punto _uno_\n1. punto `dos`\n> cita *breve*\n\n| Norma | Art. |\n|---|:--|\n| **DDU** 1 | [uno](http://x) |"
            "\n| LGUC | 2 |\n---\n#### Fin\n### Cierre\n| sola |\nfin  ")
_MD_SQL = "'" + MARKDOWN.replace("\n", "' || chr(10) || '") + "'"


def formatted_answers(t):
    return d.answers(t).withColumn("respuesta", F.concat("respuesta", F.lit(MARKDOWN)))


def sql_inline(x: str) -> str:
    for p, r in ((r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"`(.+?)`", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
                 (r"_{1,2}(.+?)_{1,2}", r"\1")):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


_MD = {
    "formatted": f"SELECT query_id, respuesta || {_MD_SQL} AS respuesta FROM answers",
    "lines": """SELECT query_id, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(raw, '\\s+$', '') AS s FROM (
  SELECT query_id, unnest(string_split(respuesta, chr(10))) AS raw, generate_subscripts(string_split(respuesta, chr(10)), 1) AS i FROM formatted)""",
}
_KINDS = " ".join(f"WHEN regexp_matches(s, '{t}') THEN '{k}'" for k, t, _ in ops.LINE_KINDS)
_BODY = " ".join(f"WHEN regexp_matches(s, '{t}') THEN regexp_replace(s, '{m}', '')" for _, t, m in ops.LINE_KINDS)


@query("strip_markdown", d.with_("answers", f"""
SELECT query_id, pos, CASE WHEN trim(s) = '' THEN 'vacio' {_KINDS} WHEN regexp_matches(s, '{ops.TABLE_RULE}') THEN 'vacio'
  WHEN regexp_matches(s, '{ops.TABLE_ROW}') THEN 'tabla_fila' WHEN regexp_matches(s, '^---+$') THEN 'hr' ELSE 'texto' END AS tipo,
  {sql_inline(f"CASE WHEN trim(s) = '' THEN '' {_BODY} WHEN regexp_matches(s, '{ops.TABLE_RULE}') OR regexp_matches(s, '^---+$') THEN '' ELSE s END")} AS contenido
FROM lines""", _MD))
def strip_markdown(t):
    return ops.strip_markdown(formatted_answers(t))


@query("markdown_tables", d.with_("answers", f"""
SELECT query_id, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY grp) - 1 AS INTEGER) AS tabla, CAST(fila AS INTEGER) AS fila,
  CAST(c - 1 AS INTEGER) AS columna, encabezado, celda FROM (
  SELECT query_id, grp, fila, unnest(cells) AS celda, generate_subscripts(cells, 1) AS c, unnest(head) AS encabezado FROM (
    SELECT query_id, grp, fila, cells, first_value(cells) OVER (PARTITION BY query_id, grp ORDER BY fila) AS head,
           count(*) OVER (PARTITION BY query_id, grp) AS n FROM (
      SELECT query_id, grp, row_number() OVER (PARTITION BY query_id, grp ORDER BY pos) - 1 AS fila,
        list_transform(string_split(trim(s), '|')[2:-2], lambda x: {sql_inline('trim(x)')}) AS cells
      FROM (SELECT *, pos - row_number() OVER (PARTITION BY query_id ORDER BY pos) AS grp FROM lines
            WHERE regexp_matches(trim(s), '{ops.TABLE_ROW}'))
      WHERE NOT regexp_matches(trim(s), '{ops.TABLE_RULE}'))) WHERE n >= 2 AND fila > 0)""", _MD))
def markdown_tables(t):
    return ops.markdown_tables(formatted_answers(t))


@query("strip_json_fence", d.with_("questions", """
SELECT query_id, texto AS standalone_query, CASE WHEN ok THEN 'ampliacion' ELSE 'consulta_normativa' END AS tipo_proyecto,
  CASE WHEN ok THEN 'aguas,salud,vialidad' ELSE 'construccion' END AS dominios, CASE WHEN ok THEN 'alta' ELSE 'baja' END AS confianza,
  CASE WHEN ok THEN 'resumen' ELSE left(texto, 120) END AS resumen_consulta, ok AS valida
FROM (SELECT *, query_id % 3 <> 0 AS ok FROM questions)"""))
def strip_json_fence(t):
    inner = F.to_json(F.struct(
        F.col("texto").alias("standalone_query"),
        F.struct(F.lit("ampliacion").alias("tipo_proyecto"), F.lit("obra").alias("etapa"),
                 F.array(*[F.lit(x) for x in ("aguas", "salud", "vialidad", "defensa")]).alias("dominios_detectados"),
                 F.array(F.lit("LGUC")).alias("keywords_normativas"), F.lit(True).alias("requiere_jerarquia"),
                 F.lit("alta").alias("confianza"), F.lit("resumen").alias("resumen_consulta")).alias("clasificacion")))
    raw = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("```json\nNo puedo: "), inner)).otherwise(
        F.concat(F.lit("\n```json\n"), inner, F.lit("\n```\n")))
    outputs = d.questions(t).select("query_id", F.col("texto").alias("pregunta"), raw.alias("raw"))
    return ops.parse_classification(outputs, max_list=3).select(
        "query_id", "standalone_query", "tipo_proyecto", F.array_join("dominios_detectados", ",").alias("dominios"),
        "confianza", "resumen_consulta", "valida")


ERRORS = ["HTTP 429", "quota exceeded", "límite de uso", "conexión cerrada", "503 Service", "Failed to parse chunk", "input too large"]


def error_log(t):
    """One error text per event; events of other types carry none."""
    text = F.concat(d.pick(ERRORS, F.col("event_id")), F.lit(" at "), F.col("user_id").cast("string"))
    return t.events.select("event_id", F.when(F.col("event_type") == "error", text).alias("error"))


ERROR_SQL = {"error_log": f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN {d.sql_pick(ERRORS, 'event_id')} || ' at ' || user_id END AS error FROM events"""}


def sql_marker(markers: list[str], x: str) -> str:
    return "coalesce(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ", false)"


@query("error_kind", d.with_("", f"""
SELECT event_id, CASE WHEN {sql_marker(P.QUOTA_ERRORS, 'error')} THEN 'quota' ELSE 'other' END AS tipo FROM error_log WHERE error IS NOT NULL""", ERROR_SQL))
def error_kind(t):
    return error_log(t).where("error IS NOT NULL").select("event_id", ops.error_kind(F.col("error")).alias("tipo"))
