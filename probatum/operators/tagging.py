"""Taggers over question, passage and answer tables: pattern tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import UNICODE, any_match, first_hit, first_label, literal_array, matches
from ..functions.text import normalise, replace, strip
from ..lookups import patterns as P


def domain_crossings(questions: DataFrame) -> DataFrame:
    """Regulated areas a question crosses into, one row each, with the text that triggered it."""
    text = F.lower("texto")
    hits = F.array(*[
        F.struct(F.lit(no).alias("area_no"), F.lit(area).alias("area"), F.lit(authority).alias("organismo"),
                 F.lit(norm).alias("norma_probable"), first_hit(text, regexes).alias("gatillante"))
        for no, (area, authority, norm, regexes) in enumerate(P.CROSSING_AREAS)])
    found = F.filter(hits, lambda h: h["gatillante"].isNotNull())
    return questions.select("query_id", F.explode(found).alias("h")).select("query_id", "h.*")


def out_of_domain(text: Column) -> Column:
    return any_match(text, P.OUT_OF_DOMAIN)


def extract_facts(questions: DataFrame) -> DataFrame:
    """Requested action, state of the works, zone, named norm, flags and confidence of each question."""
    text = F.col("texto")
    action = first_label(text, P.ACTIONS, "")
    norm = strip(F.regexp_extract(text, UNICODE + P.NAMED_NORM, 1))
    found = questions.select(
        "query_id", action.alias("hit_action"), first_label(text, P.WORK_STATUS, "desconocido").alias("estado_obra"),
        first_label(text, P.ZONES, "desconocida").alias("zona"), F.when(norm != "", norm).alias("norma_mencionada"),
        matches(text, P.ASKS_PERMISSION).alias("consulta_procedencia"))
    named = found.withColumn("accion", F.when(F.col("hit_action") != "", F.col("hit_action")).when(
        F.col("consulta_procedencia"), F.lit("otro")).otherwise("consultar_normativa"))
    signals = sum(((F.col(c) != none).cast("int") for c, none in
                   (("hit_action", ""), ("estado_obra", "desconocido"), ("zona", "desconocida"))),
                  F.col("norma_mencionada").isNotNull().cast("int"))
    return named.select(
        "query_id", "accion", "estado_obra", "zona", "norma_mencionada",
        ((F.col("estado_obra") == "con_recepcion") & F.col("accion").isin(P.ACTIONS_ON_RECEIVED_WORKS))
        .alias("sobre_obra_recepcionada"),
        "consulta_procedencia",
        F.when(signals >= 2, "alta").when(signals == 1, "media").otherwise("baja").alias("confianza"))


def restriction_tagger(passages: DataFrame) -> DataFrame:
    """Label of each passage (restrictive, exception, general) with the wording found and its surroundings."""
    text = F.col("texto")
    tagged = passages.withColumn("patron", first_hit(text, P.RESTRICTIVE))
    at = F.instr(F.lower(text), F.lower("patron"))
    start = F.greatest(at - 60, F.lit(1))
    fragment = strip(F.substring(text, start, at + F.length("patron") + 100 - start))
    label = F.when(F.col("patron").isNotNull(), "restrictivo").when(
        first_hit(text, P.EXCEPTIONS).isNotNull(), "excepcion").otherwise("general")
    return tagged.withColumn("etiqueta", label).withColumn("fragmento", F.when(F.col("patron").isNotNull(), fragment))


def restriction_summary(evidence: DataFrame, shown: int = 5, width: int = 250) -> DataFrame:
    """Per query: passages of each label, whether any restricts, and the first fragments.

    The first fragments are kept per task before the shuffle, so a query with very many passages is safe.
    """
    tagged = restriction_tagger(evidence)
    counts = tagged.groupBy("query_id").agg(
        F.count_if(F.col("etiqueta") == "restrictivo").alias("restrictivos"),
        F.count_if(F.col("etiqueta") == "excepcion").alias("excepciones"),
        F.count_if(F.col("etiqueta") == "general").alias("generales"))
    window = Window.partitionBy("query_id").orderBy(F.col("patron").isNull(), "rank", "chunk_id")
    first = (
        tagged.select("query_id", "chunk_id", "rank", "norma", "patron", "fragmento")
        .withColumn("n", F.row_number().over(window)).where(F.col("n") <= shown).where("patron IS NOT NULL").groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("n", "norma", "patron", F.substring("fragmento", 1, width).alias("fragmento"))))
             .alias("primeros")))
    return counts.join(first, "query_id", "left").select(
        "query_id", "restrictivos", "excepciones", "generales", (F.col("restrictivos") > 0).alias("hay_conflicto"), "primeros")


def suspicious_refs(questions: DataFrame) -> DataFrame:
    """References that cannot exist, from keywords and question text: ``(query_id, n, referencia)``.

    Give ``keywords array<string>`` beside ``texto``; every suspicious source is a row, in order.
    """
    in_text = F.regexp_extract_all("texto", F.lit("(?i)" + P.REF_ANY), F.lit(0))
    sources = questions.select(
        "query_id", matches(F.col("texto"), P.MENTIONS_LAW_CODE).alias("law_code"),
        F.posexplode(F.concat(F.col("keywords"), in_text)).alias("n", "fuente"))

    def number(pattern: str) -> Column:
        return F.regexp_replace(F.nullif(F.regexp_extract("fuente", "(?i)" + pattern, 1), F.lit("")), r"^0+(?=\d)", "")

    def over(digits: Column, most: int) -> Column:
        """Whether a number of any length is over ``most``: more digits, or as many and later in order."""
        limit = str(most)
        return (F.length(digits) > len(limit)) | ((F.length(digits) == len(limit)) & (digits > limit))

    law_code = F.col("law_code") | matches(F.col("fuente"), P.MENTIONS_LAW_CODE)
    article, circular = number(P.REF_ARTICLE), number(P.REF_CIRCULAR)
    named = (
        F.when(over(article, P.MAX_ARTICLE), F.concat(F.lit("Art. "), article))
        .when(law_code & over(article, P.MAX_ARTICLE_LAW_CODE), F.concat(F.lit("Art. "), article, F.lit(" LGUC")))
        .when(over(circular, P.MAX_CIRCULAR), F.concat(F.lit("DDU "), circular)))
    return sources.withColumn("referencia", named).where("referencia IS NOT NULL").select("query_id", "n", "fuente", "referencia")


def named_suspicious(refs: DataFrame) -> DataFrame:
    """Per query the number of suspicious sources and the reference to name (the last)."""
    return refs.groupBy("query_id").agg(F.count("*").alias("sospechosos"), F.max_by("referencia", "n").alias("referencia"))


def inline_markdown(text: Column) -> Column:
    """Text without bold, italic, code, link and underscore markers."""
    return replace(text, (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`(.+?)`", "$1"),
                   (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"_{1,2}(.+?)_{1,2}", "$1"))


# Line kinds of an answer in order of test: (kind, test, marker to remove).
LINE_KINDS = [
    ("h4", r"^#{4}\s", r"^#{4}\s*"),
    ("h3", r"^#{3}\s", r"^#{3}\s*"),
    ("h2", r"^#{2}\s", r"^#{2}\s*"),
    ("bullet", r"^[-*]\s", r"^[-*]\s*"),
    ("bullet", r"^\d+\.\s", r"^\d+\.\s*"),
    ("cita", r"^>\s", r"^>\s*"),
]
TABLE_ROW = r"^\|.+\|$"
TABLE_RULE = r"^\|[-| :]+\|$"


def strip_markdown(answers: DataFrame) -> DataFrame:
    """Lines of each answer with their kind and plain content."""
    lines = answers.select("query_id", F.posexplode(F.split("respuesta", "\n")).alias("pos", "raw"))
    s = F.regexp_replace("raw", r"\s+$", "")
    kind, content = F.when(strip(s) == "", "vacio"), F.when(strip(s) == "", "")
    for name, test, marker in LINE_KINDS:
        kind = kind.when(s.rlike(test), name)
        content = content.when(s.rlike(test), F.regexp_replace(s, marker, ""))
    kind = kind.when(s.rlike(TABLE_RULE), "vacio").when(s.rlike(TABLE_ROW), "tabla_fila").when(s.rlike("^---+$"), "hr")
    content = content.when(s.rlike(TABLE_RULE), "").when(s.rlike("^---+$"), "")
    return lines.select("query_id", "pos", kind.otherwise("texto").alias("tipo"),
                        inline_markdown(content.otherwise(s)).alias("contenido"))


def markdown_tables(answers: DataFrame) -> DataFrame:
    """Data cells of the tables in each answer: ``(query_id, tabla, fila, columna, encabezado, celda)``.

    Consecutive table lines form a table; rule lines are skipped; a table needs a header and a data row.
    The lines of one answer stay inside its row.
    """
    lines = F.transform(F.split("respuesta", "\n"), lambda x: strip(x))
    grouped = F.regexp_extract_all(F.concat(F.array_join(lines, "\n"), F.lit("\n")), F.lit(r"(?m)((?:^\|.+\|\n)+)"), F.lit(1))
    rows = answers.select("query_id", F.posexplode(grouped).alias("tabla", "block")).select(
        "query_id", "tabla", F.filter(F.split("block", "\n"), lambda x: (x != "") & ~x.rlike(TABLE_RULE)).alias("rows"))

    def cells(row: Column) -> Column:
        parts = F.split(row, r"\|")
        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda c: inline_markdown(strip(c)))

    tables = rows.where(F.size("rows") >= 2).withColumn("head", cells(F.get("rows", F.lit(0))))
    body = tables.select("query_id", "tabla", "head", F.posexplode("rows").alias("fila", "row")).where("fila > 0")
    return body.select("query_id", "tabla", "fila", "head", F.posexplode(cells(F.col("row"))).alias("columna", "celda")).select(
        "query_id", "tabla", "fila", "columna", F.get("head", F.col("columna")).alias("encabezado"), "celda")


def strip_json_fence(text: Column) -> Column:
    """Model output without the code fence around it."""
    return strip(replace(text, (r"(?i)^\s*```(?:json)?\s*", ""), (r"(?i)\s*```\s*$", "")))


PROFILE_SCHEMA = (
    "standalone_query string, clasificacion struct<tipo_proyecto:string,etapa:string,dominios_detectados:array<string>,"
    "keywords_normativas:array<string>,requiere_jerarquia:boolean,confianza:string,resumen_consulta:string>, _corrupt_record string"
)


def parse_classification(outputs: DataFrame, max_list: int | None = None) -> DataFrame:
    """Externally produced classifications ``(query_id, pregunta, raw)`` to columns.

    Output that is not the expected JSON gives the fallback record built from the question.
    """
    parsed = outputs.withColumn("p", F.from_json(strip_json_fence(F.col("raw")), PROFILE_SCHEMA))
    ok = F.col("p._corrupt_record").isNull() & F.col("p.clasificacion").isNotNull()

    def value(name: str, fallback: Column) -> Column:
        return F.when(ok, F.col(f"p.clasificacion.{name}")).otherwise(fallback).alias(name)

    none = F.array().cast("array<string>")
    domains = F.coalesce(F.when(ok, F.col("p.clasificacion.dominios_detectados")), F.array(F.lit("construccion")))
    return parsed.select(
        "query_id", F.when(ok, F.coalesce("p.standalone_query", "pregunta")).otherwise(F.col("pregunta")).alias("standalone_query"),
        value("tipo_proyecto", F.lit("consulta_normativa")), value("etapa", F.lit("no_aplica")),
        (F.slice(domains, 1, max_list) if max_list else domains).alias("dominios_detectados"),
        value("keywords_normativas", none), value("requiere_jerarquia", F.lit(False)), value("confianza", F.lit("baja")),
        value("resumen_consulta", F.substring("pregunta", 1, 120)), ok.alias("valida"))


def contains_marker(text: Column, markers: list[str]) -> Column:
    """True if the text holds one of the markers, as written."""
    return F.coalesce(F.exists(literal_array(markers), lambda m: F.contains(text, m)), F.lit(False))


def error_kind(text: Column) -> Column:
    return F.when(contains_marker(text, P.QUOTA_ERRORS), "quota").otherwise("other")


def transient_error(text: Column) -> Column:
    return contains_marker(text, P.TRANSIENT_ERRORS)


normalise_text = normalise
