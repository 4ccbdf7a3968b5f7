"""Sections to overlapping chunks. Sizes are folded over small integer arrays inside the row; text is
sliced once at the end. Nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import let, pack_sentences
from ..functions.text import PARAGRAPH_BREAK, estimate_tokens, strip
from .segmentation import hierarchy_label

MAX_TOKENS = 600
OVERLAP_TOKENS = 100
CHUNK_CHARS = 600
OVERLAP_CHARS = 80
CHARS_PER_WORD = 6


def paragraphs_of(text: Column, max_tokens: int = MAX_TOKENS, separator: str = PARAGRAPH_BREAK) -> Column:
    """Paragraphs of a text; one longer than ``max_tokens`` is cut into packs of sentences."""
    whole = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    return F.flatten(F.transform(whole, lambda p: F.when(estimate_tokens(p) <= max_tokens, F.array(p)).otherwise(
        pack_sentences(p, max_tokens))))


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def _range(a: Column, b: Column) -> Column:
    """Integers a..b, empty if b < a."""
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def windows_of(tokens: Column, max_tokens: int, overlap: int, emit_tail_suffixes: bool = False) -> Column:
    """Windows ``(a, b)`` of paragraph numbers, end exclusive.

    A window is filled while it stays within ``max_tokens``. The next one starts as far back as needed for
    ``overlap`` tokens, but at least one paragraph later. Windows that only repeat the end of the text are
    left out unless asked for.
    """

    return let(tokens, lambda sizes: let(_running(sizes), lambda upto: _windows(
        sizes, upto, max_tokens, overlap, emit_tail_suffixes)))


def _running(sizes: Column) -> Column:
    """Sums of the first 0, 1, 2, ... sizes."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda upto, x: F.concat(upto, F.array(F.element_at(upto, -1) + x)))


def _windows(sizes: Column, upto: Column, max_tokens: int, overlap: int, emit_tail_suffixes: bool) -> Column:

    def between(r: Column, i: Column) -> Column:
        return F.get(upto, i) - F.get(upto, r)

    def restart(s: Column, i: Column) -> Column:
        enough = F.filter(_range(s + 1, i - 1), lambda r: between(r, i) >= overlap)
        return F.coalesce(F.array_max(enough), F.least(s + 1, i))

    def step(state: Column, i: Column) -> Column:
        t, s = F.get(sizes, i), state["s"]
        full = (state["acc"] + t > max_tokens) & (i > s)

        def reopen(back: Column) -> Column:
            repeated = F.filter(_range(back, i - 1), lambda r: between(r, i) + t > max_tokens)
            return let(repeated, lambda again: let((back + F.size(again)).cast("int"), lambda start: F.struct(
                start.alias("s"), (between(start, i) + t).cast("int").alias("acc"),
                F.concat(state["out"], F.array(_span(s, i)), F.transform(again, lambda r: _span(r, i))).alias("out"))))

        grown = F.struct(s.alias("s"), (state["acc"] + t).cast("int").alias("acc"), state["out"].alias("out"))
        return F.when(full, let(restart(s, i), reopen)).otherwise(grown)

    def close(state: Column) -> Column:
        n = F.size(sizes)
        out = F.concat(state["out"], F.array(_span(state["s"], n)))
        if emit_tail_suffixes:
            back = restart(state["s"], n)
            out = F.concat(out, F.transform(_range(back, n - 1), lambda r: _span(r, n)))
        return out

    empty = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("acc"), empty.alias("out"))
    folded = F.aggregate(_range(F.lit(0), F.size(sizes) - 1), start, step, close)
    return F.when(F.size(sizes) == 0, empty).otherwise(folded)


def overlapping(
    paragraphs: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, emit_tail_suffixes: bool = False
) -> Column:
    """Chunk texts of a section: one if it fits whole, else overlapping windows of paragraphs."""
    length = F.aggregate(paragraphs, F.lit(-2), lambda n, p: n + F.length(p) + 2)  # of the paragraphs joined
    spans = windows_of(F.transform(paragraphs, estimate_tokens), max_tokens, overlap, emit_tail_suffixes)
    cut = F.transform(spans, lambda w: F.array_join(F.slice(paragraphs, w["a"] + 1, w["b"] - w["a"]), "\n\n"))
    return F.when(F.size(paragraphs) == 0, F.array().cast("array<string>")).when(
        F.ceil(length / 4) <= max_tokens, F.array(F.array_join(paragraphs, "\n\n"))).otherwise(cut)


def chunk_overlap(
    docs: DataFrame, text_col: str = "texto", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
    separator: str = PARAGRAPH_BREAK, emit_tail_suffixes: bool = False,
) -> DataFrame:
    """One row per chunk of a text: ``(doc_id, orden, texto, tokens)``."""
    parted = docs.select("doc_id", paragraphs_of(F.col(text_col), max_tokens, separator).alias("p"))
    chunks = overlapping(F.col("p"), max_tokens, overlap, emit_tail_suffixes)
    return parted.select("doc_id", F.posexplode(chunks).alias("orden", "texto")).withColumn(
        "tokens", estimate_tokens(F.col("texto")))


def chunk_documents(
    docs: DataFrame, sections: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
    separator: str = PARAGRAPH_BREAK,
) -> DataFrame:
    """All chunks of documents ``(doc_id, tipo, numero, url)`` from their array of sections.

    Every chunk begins with a line that places it: type, number, headings, article, title, part.
    """
    keyed = docs.select("doc_id", "tipo", "numero", "url", sections.alias("sections"))
    present = {f.name for f in keyed.schema["sections"].dataType.elementType.fields}

    def part(s: Column, name: str) -> Column:
        return s[name] if name in present else F.lit(None).cast("string")

    parted = keyed.withColumn("sections", F.transform("sections", lambda s: F.struct(
        part(s, "numero").alias("articulo"), part(s, "titulo_articulo").alias("titulo_articulo"),
        hierarchy_label(part(s, "titulo"), F.coalesce(part(s, "capitulo"), part(s, "parrafo"))).alias("jerarquia"),
        part(s, "vigencia_desde").alias("vigencia_desde"),
        paragraphs_of(s["texto"], max_tokens, separator).alias("p"))))
    cut = parted.withColumn("sections", F.transform("sections", lambda s: s.withField(
        "p", overlapping(s["p"], max_tokens, overlap))))
    chunks = F.flatten(F.transform("sections", lambda s: F.transform(s["p"], lambda text, i: F.struct(
        s["articulo"].alias("articulo"), s["titulo_articulo"].alias("titulo_articulo"), s["jerarquia"].alias("jerarquia"),
        s["vigencia_desde"].alias("vigencia_desde"), (i + 1).alias("part"), F.size(s["p"]).alias("parts"),
        text.alias("texto")))))
    rows = cut.select("doc_id", "tipo", "numero", "url", F.posexplode(chunks).alias("orden", "c"))
    suffix = F.when(F.col("c.parts") > 1, F.concat(F.lit(" (parte "), "c.part", F.lit("/"), "c.parts", F.lit(")"))).otherwise("")
    head = F.concat(
        F.lit("["), "tipo", F.lit(" "), "numero", F.coalesce(F.concat(F.lit(" › "), "c.jerarquia"), F.lit("")),
        F.lit(" – Art. "), "c.articulo", F.coalesce(F.concat(F.lit(": "), "c.titulo_articulo"), F.lit("")), suffix, F.lit("]\n"))
    full = rows.withColumn("texto", F.concat(head, "c.texto"))
    return full.select(
        "doc_id", "orden", "texto", estimate_tokens(F.col("texto")).alias("tokens"),
        F.struct(F.col("tipo").alias("tipo_norma"), F.col("numero").alias("numero_norma"), "c.articulo", "c.titulo_articulo",
                 "c.jerarquia", F.col("url").alias("url_fuente")).alias("metadatos"),
        F.col("c.vigencia_desde").alias("fecha_vigencia_desde"), F.lit(None).cast("string").alias("fecha_vigencia_hasta"),
        F.col("url").alias("fuente"))


def chunk_chars(
    docs: DataFrame, text_col: str = "texto", target: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
    separator: str = PARAGRAPH_BREAK,
) -> DataFrame:
    """Chunks by characters; each starts with the last words of the one before. Chunks up to 20 are dropped."""
    words = overlap // CHARS_PER_WORD
    paragraphs = F.filter(F.transform(F.split(F.col(text_col), separator), strip), lambda p: p != "")

    def step(state: Column, p: Column) -> Column:
        full = (F.length(state["buf"]) + F.length(p) + 1 > target) & (state["buf"] != "")
        past = F.split(state["buf"], " ")
        kept = F.array_join(F.slice(past, F.greatest(F.size(past) - (words - 1), F.lit(1)), F.lit(words)), " ")
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(strip(state["buf"])))).otherwise(state["out"]).alias("out"),
            F.when(full, F.concat(kept, F.lit("\n"), p)).when(state["buf"] == "", p).otherwise(
                F.concat(state["buf"], F.lit("\n"), p)).alias("buf"))

    def close(state: Column) -> Column:
        return F.when(strip(state["buf"]) == "", state["out"]).otherwise(F.concat(state["out"], F.array(strip(state["buf"]))))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    chunks = F.aggregate(paragraphs, start, step, close)
    cut = F.when(F.size(chunks) == 0, fixed_slices(F.col(text_col), target, overlap)).otherwise(chunks)
    long_enough = F.filter(cut, lambda c: F.length(c) > 20)
    return docs.select("doc_id", F.posexplode(long_enough).alias("orden", "texto"))


def fixed_slices(text: Column, target: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Slices of equal size with overlap, covering the whole text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(target - overlap))
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda s: strip(F.substring(text, s, F.lit(target)))))


def ingest_outcomes(docs: DataFrame) -> DataFrame:
    """Documents and chunks by outcome.

    docs ``(doc_id, text, hash, old_hash, sections int, chunks int, error string)``.
    """
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("text").isNull() | (strip(F.col("text")) == ""), "no_text")
        .when(F.col("hash").eqNullSafe(F.col("old_hash")), "unchanged")
        .when(F.col("sections") == 0, "parser_empty").otherwise("ok"))
    stored = F.when(F.col("status") == "ok", F.col("chunks")).otherwise(0)
    return docs.withColumn("status", status).groupBy("status").agg(
        F.count("*").alias("documents"), F.sum(stored).alias("chunks"), F.max(F.col("status") == "error").alias("failed"))
