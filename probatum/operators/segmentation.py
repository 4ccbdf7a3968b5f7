"""Documents to sections.

A document is one row, so its sections are found inside the row: the text is split before each heading,
level by level, and every section inherits the headings of the pieces it lies in. No line is shuffled;
one ``posexplode`` at the end yields the sections in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import pack_chars, pack_tokens
from ..functions.text import PARAGRAPH_BREAK, article_label, strip

MARK = "\u0001"

# Headings. Group 1 is the label or number.
ROMAN = r"(?:I{1,3}|IV|V{1,3}|VI{1,4}|IX|X|\d+)"
CODE_TITLE = rf"(?iu)^\h{{0,8}}T[IÍ]TULO\h+({ROMAN}[°\h].*?)$"
CODE_CHAPTER = rf"(?iu)^\h{{0,8}}CAP[IÍ]TULO\h+({ROMAN}[°\h].*?)$"
CODE_ARTICLE = r"^\h{0,8}Artículo\h+(\d+\h*(?:bis|ter|quáter)?)[°º]?\.?-?\h*"
DOTTED_TITLE = r"(?iu)^\h{0,8}T[IÍ]TULO\h+(\d+)"
DOTTED_CHAPTER = r"(?iu)^\h{0,8}CAP[IÍ]TULO\h+(\d+)"
DOTTED_ARTICLE = r"^\h{0,8}Artículo\h+(\d+\.\d+\.\d+)[°º]?\.?\h*"
LAW_TITLE = r"(?iu)^\h{0,8}T[ÍI]TULO\h+((?:[IVX]+|\d+)[°\h].*?)$"
LAW_CHAPTER = r"(?iu)^\h{0,8}CAP[ÍI]TULO\h+((?:[IVX]+|\d+)[°\h].*?)$"
LAW_PART = r"(?iu)^\h{0,8}P[ÁA]RRAFO\h+(\d+[°\h].*?)$"
LAW_ARTICLE = r"(?iu)^\h{0,8}Art[íi]culo\h+(\d+\h*(?:bis|ter|qu[áa]ter|quinquies)?)\h*[°º]?\h*\.?-?\h*"
CIRCULAR_SECTION = r"^\h{0,6}(\d+(?:\.\d+){0,3})\.\h+(.{3,80}?)\h*$"
CIRCULAR_NUMBERED = r"^\h{0,6}\d+\.\h+\S"
CIRCULAR_ARTICLE = r"^\h{0,8}Art[ií]culo\h+(\d+)[°º]?\.?-?\h*"
GAZETTE_DATE = r"D\.O\.\s+(\d{2}\.\d{2}\.\d{4})"

# Parts of a ruling and how each begins.
RULING_PARTS = [
    ("Antecedentes", r"(?imu)^(?:I\.?\s*)?(?:ANTECEDENTES?|Se han presentado|Han requerido|Esta Contraloría ha recibido)"),
    ("Análisis", r"(?imu)^(?:II\.?\s*)?(?:AN[ÁA]LISIS|SOBRE EL FONDO|AL RESPECTO|Sobre el particular)"),
    ("Conclusión", r"(?imu)^(?:III\.?\s*)?(?:CONCLUSI[ÓO]N|En consecuencia|Por lo expuesto|En mérito)"),
]


@dataclass(frozen=True)
class Layout:
    """Heading levels from the outside in, and the article heading."""

    levels: tuple[tuple[str, str, str], ...]  # (name, heading, label prefix)
    article: str
    min_chars: int
    reset_lower: bool = True


CODE = Layout((("titulo", CODE_TITLE, "TÍTULO "), ("capitulo", CODE_CHAPTER, "CAPÍTULO ")), CODE_ARTICLE, 20)
DOTTED = Layout((("titulo", DOTTED_TITLE, "TÍTULO "), ("capitulo", DOTTED_CHAPTER, "CAPÍTULO ")), DOTTED_ARTICLE, 20,
                reset_lower=False)
LAW = Layout((("titulo", LAW_TITLE, "TÍTULO "), ("capitulo", LAW_CHAPTER, "CAPÍTULO "), ("parrafo", LAW_PART, "PÁRRAFO ")),
             LAW_ARTICLE, 15)


def _multiline(regex: str) -> str:
    return f"(?m){regex}"


def split_before(text: Column, heading: str) -> Column:
    """Pieces of a text, each but the first starting with a heading line."""
    flags, body = ("(?ium)", heading[5:]) if heading.startswith("(?iu)") else ("(?m)", heading)
    return F.split(F.regexp_replace(text, f"{flags}(?={body})", MARK), MARK)


def sections_of(text: Column, layout: Layout) -> Column:
    """Array of ``(titulo, capitulo, parrafo, numero, texto)`` in text order."""
    names = [name for name, _, _ in layout.levels]

    def articles(piece: Column, context: dict[str, Column]) -> Column:
        pieces = split_before(piece, layout.article)
        found = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.transform(found, lambda p: F.struct(
            *[context[n].alias(n) for n in names],
            article_label(F.regexp_extract(p, _multiline(layout.article), 1)).alias("numero"),
            strip(p).alias("texto")))

    def walk(piece: Column, depth: int, context: dict[str, Column], carried: dict[str, Column]) -> Column:
        if depth == len(layout.levels):
            return articles(piece, context)
        name, heading, prefix = layout.levels[depth]
        pieces = split_before(piece, heading)

        def label(p: Column) -> Column:
            return F.concat(F.lit(prefix), strip(F.regexp_extract(p, _multiline(heading), 1)))

        def inner(p: Column, i: Column) -> Column:
            own = F.when(i > 0, label(p)).otherwise(carried.get(name, F.lit(None).cast("string")))
            below = {}
            if not layout.reset_lower and depth + 1 < len(layout.levels):
                lower, lower_heading, lower_prefix = layout.levels[depth + 1]
                last_seen = F.transform(pieces, lambda q: F.try_element_at(
                    F.regexp_extract_all(q, F.lit(_multiline(lower_heading)), F.lit(1)), F.lit(-1)))
                earlier = F.filter(F.slice(last_seen, F.lit(1), i), lambda x: x.isNotNull())
                below[lower] = F.concat(F.lit(lower_prefix), strip(F.try_element_at(earlier, F.lit(-1))))
            return walk(p, depth + 1, {**context, name: own}, below)

        return F.flatten(F.transform(pieces, inner))

    clean = F.replace(text, F.lit(MARK), F.lit(""))
    return F.filter(walk(clean, 0, {}, {}), lambda s: F.length(s["texto"]) >= layout.min_chars)


def last_gazette_date(text: Column) -> Column:
    """Last gazette date of a text as ISO date, null if it has none."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(GAZETTE_DATE), F.lit(1)), F.lit(-1))
    return F.regexp_replace(last, r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")


def segment(docs: DataFrame, layout: Layout, text_col: str = "texto") -> DataFrame:
    """One row per article: ``(doc_id, orden, titulo, capitulo, numero, texto, vigencia_desde)``."""
    rows = docs.select("doc_id", F.posexplode(sections_of(F.col(text_col), layout)).alias("orden", "s"))
    return rows.select(
        "doc_id", "orden", "s.titulo", "s.capitulo", "s.numero", "s.texto",
        last_gazette_date(F.col("s.texto")).alias("vigencia_desde"))


def law_sections(text: Column, least: int = 100, paragraph: str = PARAGRAPH_BREAK) -> Column:
    """Articles of a law; a text without any is cut into its long paragraphs, numbered p1, p2, ..."""
    paragraphs = F.filter(F.transform(F.split(text, paragraph), strip), lambda p: F.length(p) > least)
    none = F.lit(None).cast("string")
    fallback = F.transform(paragraphs, lambda p, i: F.struct(
        none.alias("titulo"), none.alias("capitulo"), none.alias("parrafo"),
        F.concat(F.lit("p"), (i + 1).cast("string")).alias("numero"), p.alias("texto")))
    found = sections_of(text, LAW)
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def segment_law(docs: DataFrame, text_col: str = "texto", least: int = 100, paragraph: str = PARAGRAPH_BREAK) -> DataFrame:
    """One row per section of :func:`law_sections`."""
    return docs.select("doc_id", F.posexplode(law_sections(F.col(text_col), least, paragraph)).alias("orden", "s")).select(
        "doc_id", "orden", "s.titulo", F.coalesce("s.capitulo", "s.parrafo").alias("capitulo"), "s.numero", "s.texto")


def blocks_of(text: Column, max_tokens: int = 700, least: int = 20, paragraph: str = PARAGRAPH_BREAK) -> Column:
    """Greedy blocks of whole paragraphs."""
    kept = F.filter(F.transform(F.split(text, paragraph), strip), lambda p: F.length(p) > least)
    return pack_tokens(kept, max_tokens)


def numbered_sections(text: Column, max_tokens: int = 700, paragraph: str = PARAGRAPH_BREAK) -> Column:
    """Circulars: numbered sections if there are at least three numbered lines and two sections, else articles, else blocks."""

    def pieces(heading: str, titled: bool) -> Column:
        parts = split_before(F.replace(text, F.lit(MARK), F.lit("")), heading)
        kept = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(strip(p)) >= 30)
        title = (lambda p: strip(F.regexp_extract(p, _multiline(heading), 2))) if titled else (
            lambda p: F.lit(None).cast("string"))
        return F.transform(kept, lambda p: F.struct(
            F.regexp_extract(p, _multiline(heading), 1).alias("numero"), title(p).alias("titulo"), strip(p).alias("texto")))

    blocks = F.transform(blocks_of(text, max_tokens, paragraph=paragraph), lambda b, i: F.struct(
        F.concat(F.lit("bloque-"), (i + 1).cast("string")).alias("numero"), F.lit(None).cast("string").alias("titulo"),
        strip(b).alias("texto")))
    by_section, by_article = pieces(CIRCULAR_SECTION, True), pieces(CIRCULAR_ARTICLE, False)
    numbered = F.regexp_count(text, F.lit(_multiline(CIRCULAR_NUMBERED)))
    return (F.when((numbered >= 3) & (F.size(by_section) >= 2), by_section)
            .when(F.size(by_article) >= 1, by_article).otherwise(blocks))


def segment_numbered(
    docs: DataFrame, text_col: str = "texto", head_chars: int | None = None, max_tokens: int = 700, paragraph: str = PARAGRAPH_BREAK
) -> DataFrame:
    """One row per section of :func:`numbered_sections`. Sections without a gazette date take the document's: the last one in its
    first ``head_chars`` characters, by default in all of it."""
    text = F.col(text_col)
    published = last_gazette_date(text if head_chars is None else F.substring(text, 1, head_chars))
    rows = docs.select("doc_id", published.alias("published"), F.posexplode(numbered_sections(text, max_tokens, paragraph)).alias("orden", "s"))
    return rows.select(
        "doc_id", "orden", "s.numero", "s.titulo", "s.texto",
        F.coalesce(last_gazette_date(F.col("s.texto")), "published").alias("vigencia_desde"))


def segment_blocks(
    docs: DataFrame, text_col: str = "texto", max_tokens: int = 700, paragraph: str = PARAGRAPH_BREAK
) -> DataFrame:
    """Only the greedy blocks: ``(doc_id, orden, texto)``."""
    return docs.select("doc_id", F.posexplode(blocks_of(F.col(text_col), max_tokens, paragraph=paragraph))
                       .alias("orden", "texto"))


def ruling_sections(text: Column, number: Column, title: Column, target: int = 700, least: int = 80) -> Column:
    """Array of ``(numero, titulo, texto)``: the parts of a ruling found by their opening words, cut into blocks; a ruling
    with fewer than two parts is cut as a whole. The first section carries the ruling's title."""
    found = F.array_sort(F.filter(F.array(*[
        F.struct(F.regexp_instr(text, F.lit(rx)).alias("at"), F.lit(name).alias("name")) for name, rx in RULING_PARTS
    ]), lambda s: s["at"] > 0))

    def cut(starts: Column) -> Column:
        parts = F.filter(F.transform(starts, lambda s, i: F.struct(
            s["name"].alias("name"),
            strip(F.substring(text, s["at"], F.coalesce(F.get(starts, i + 1)["at"], F.length(text) + 1) - s["at"])).alias("body"))),
            lambda p: F.length(p["body"]) > 50)
        whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), text.alias("body")))

        def blocks(body: Column) -> Column:
            paragraphs = F.filter(F.transform(F.split(body, "\n\n+"), strip), lambda p: p != "")
            return F.filter(F.transform(pack_chars(paragraphs, target), strip), lambda b: F.length(b) >= least)

        return F.flatten(F.transform(F.when(F.size(parts) >= 2, parts).otherwise(whole), lambda p: F.transform(
            blocks(p["body"]), lambda b: F.struct(p["name"].alias("name"), b.alias("texto")))))

    def named(s: Column, i: Column) -> Column:
        part = F.replace(F.lower(s["name"]), F.lit(" "), F.lit("-"))
        return F.struct(F.concat_ws("-", number, part, (i + 1).cast("string")).alias("numero"), s["name"].alias("titulo"),
                        title_prefix(i, number, title, s["texto"]).alias("texto"))

    # the parts are found once: they are the one element of an array that the rest maps over
    return F.flatten(F.transform(F.array(found), lambda starts: F.transform(cut(starts), named)))


def segment_ruling(docs: DataFrame, text_col: str = "texto", target: int = 700, least: int = 80) -> DataFrame:
    """Rulings ``(doc_id, number, title, text)``, one row per section of :func:`ruling_sections`."""
    cut = ruling_sections(F.col(text_col), F.col("number"), F.col("title"), target, least)
    return docs.select("doc_id", F.posexplode(cut).alias("orden", "s")).select("doc_id", "orden", "s.numero", "s.titulo", "s.texto")


def title_prefix(order: Column, number: Column, title: Column, text: Column) -> Column:
    """The first section of a ruling names the ruling."""
    head = F.concat(F.lit("[Dictamen CGR N° "), number, F.lit(": "), title, F.lit("]\n\n"), text)
    return F.when((order == 0) & title.isNotNull(), head).otherwise(text)


def sections_by_type(tipo: Column, numero: Column, titulo: Column, text: Column) -> Column:
    """Sections of a document by the layout of its type: code, dotted code, laws and decrees, rulings, and circulars for all others.

    Array of ``(titulo, capitulo, parrafo, numero, texto, vigencia_desde)``; only the branch of the row's type is worked out. A
    circular's section without a gazette date takes the last one of the document's head, of 3,000 characters: later dates there belong
    to norms it quotes.
    """
    none, kind = F.lit(None).cast("string"), F.upper(tipo)
    head = last_gazette_date(F.substring(text, 1, 3000))

    def shaped(found: Column, names: tuple[str, ...], published: Column = none) -> Column:
        return F.transform(found, lambda s: F.struct(
            *[(s[name] if name in names else none).alias(name) for name in ("titulo", "capitulo", "parrafo")], s["numero"].alias("numero"),
            s["texto"].alias("texto"), F.coalesce(last_gazette_date(s["texto"]), published).alias("vigencia_desde")))

    return (F.when(kind == "LGUC", shaped(sections_of(text, CODE), ("titulo", "capitulo")))
            .when(kind == "OGUC", shaped(sections_of(text, DOTTED), ("titulo", "capitulo")))
            .when(kind.isin("LEY", "DFL", "DL", "DS"), shaped(law_sections(text), ("titulo", "capitulo", "parrafo")))
            .when(kind == "CGR", shaped(ruling_sections(text, numero, titulo), ("titulo",)))
            .otherwise(shaped(numbered_sections(text), ("titulo",), head)))


def hierarchy_label(*parts: Column) -> Column:
    """``título › capítulo`` without blanks; null when nothing is set."""
    label = F.concat_ws(" › ", *[F.when(p != "", p) for p in parts])
    return F.when(label != "", label)
