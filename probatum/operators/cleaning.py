"""Cleaning of raw texts and pages. All are narrow projections over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_to_text, replace, strip
from ..lookups.norms import (
    CODE_PAGE_HEADER, FILE_IGNORE, FILE_SOURCES, LAW_PAGE_HEADER, NAV_MAX_LINES, NAV_WORDS, RULING_PAGE_HEADER,
    RULING_SIGNATURE,
)

LINE_NUMBER = r"(?m)^\s*\d+\s*$"
DASHED_NUMBER = r"(?m)^\s*[-–]\s*\d+\s*[-–]\s*$"


def clean_text(text: Column, kind: str = "circular") -> Column:
    """Line ends, tabs, runs of blanks and page furniture; ``kind`` is code, law or circular."""
    if kind == "code":
        text = replace(text, (CODE_PAGE_HEADER, ""))
    if kind == "law":
        text = replace(strip_nav_header(decode_json_text(text)), (LAW_PAGE_HEADER, ""))
    text = replace(text, ("\r\n", "\n"), ("\t", " "), (" {3,}", "  "))
    if kind == "law":
        text = replace(text, (LINE_NUMBER, ""))
    return strip(replace(text, (r"\n{4,}", "\n\n\n")))


def clean_ruling_text(text: Column) -> Column:
    """Ruling text without page furniture, cut where the signature begins."""
    body = strip(replace(text, (RULING_PAGE_HEADER, ""), (DASHED_NUMBER, ""), ("\r\n", "\n"), ("\r", "\n"),
                         (r"\n{4,}", "\n\n\n")))
    at = F.regexp_instr(body, F.lit(RULING_SIGNATURE))
    return strip(F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(body))


def decode_json_text(text: Column) -> Column:
    """Undo a text stored as a JSON string literal; a broken literal is unescaped by hand."""
    raw = strip(text)
    parsed = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string, _corrupt_record string")
    inner = F.when(F.endswith(raw, F.lit('"')), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(
        F.substring(raw, F.lit(2), F.length(raw)))
    by_hand = inner
    for escaped, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", ""), ('\\"', '"')):
        by_hand = F.replace(by_hand, F.lit(escaped), F.lit(char))
    encoded = F.startswith(raw, F.lit('"')) & F.contains(raw, F.lit("\\n"))
    decoded = F.when(parsed["_corrupt_record"].isNull(), parsed["v"])
    return F.when(encoded, F.coalesce(decoded, by_hand)).otherwise(text)


def strip_nav_header(text: Column) -> Column:
    """Drop leading lines, 25 at most, that are blank or navigation words."""
    lines = F.split(text, "\n")
    keep = F.transform(F.slice(lines, 1, NAV_MAX_LINES), lambda x: ~strip(x).isin("", *NAV_WORDS))
    first = F.array_position(keep, True)
    start = F.when(first == 0, F.size(keep)).otherwise(first - 1).cast("int")
    return F.when(start > 0, F.array_join(F.slice(lines, start + 1, F.greatest(F.size(lines), F.lit(1))), "\n")).otherwise(text)


def extract_links(pages: DataFrame, host: str, special: bool = False) -> DataFrame:
    """PDF links of index pages on one host: one row per page and document key, first occurrence.

    The number comes from the link text, else from the address. pages ``(page_id, html)``.
    """
    anchor = r'(?is)<a\b[^>]*?href="([^"]*\.pdf)"[^>]*>(.*?)</a>'
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("label"))
    links = pages.select("page_id", F.posexplode(found).alias("pos", "a")).select(
        "page_id", "pos", F.col("a.href").alias("url"),
        strip(F.regexp_replace("a.label", "<[^>]+>", "")).alias("label")).where(F.contains("url", F.lit(host)))

    def either(text_rx: str, url_rx: str, group: int) -> Column:
        by_text = F.regexp_extract("label", text_rx, group)
        return F.when(F.regexp_extract("label", text_rx, 0) != "", by_text).otherwise(F.regexp_extract("url", url_rx, group))

    if special:
        rx = (r"(?i)DDU[- ]ESP[- ]?(\d+)[- ](\d+)", r"(?i)DDU[-_]ESP[-_]?(\d+)[- _](\d+)")
        number = F.concat(_pad3(either(*rx, 1)), F.lit("-"), either(*rx, 2))
        prefix = "DDU-ESP-"
    else:
        rx = (r"(?i)DDU\s+(\d+)", r"(?i)DDU-?(\d+)\.pdf")
        number, prefix = _pad3(either(*rx, 1)), "DDU-"
    keyed = links.where(either(*rx, 1) != "").withColumn("numero", number)
    return (
        keyed.groupBy("page_id", F.concat(F.lit(prefix), "numero").alias("key"))
        .agg(F.min_by(F.struct("numero", F.substring("label", 1, 150).alias("titulo"), "url"), "pos").alias("x"))
        .select("page_id", "key", "x.numero", "x.titulo", "x.url")
    )


def _pad3(col: Column) -> Column:
    return F.when(F.length(col) < 3, F.lpad(col, 3, "0")).otherwise(col)


def extract_version_date(html: Column, doc: Column | None = None) -> Column:
    """Version date in a page's export link, null if there is none; with ``doc`` only for that number."""
    number = F.lit(r"\d+") if doc is None else doc
    pattern = F.concat(F.lit("hddResultadoExportar="), number, F.lit(r"\.(\d{4}-\d{2}-\d{2})"))
    return F.get(F.regexp_extract_all(html, pattern, F.lit(1)), F.lit(0))


def pick_best_text_field(fields: list[Column], number: Column, year: Column, least: int = 200) -> Column:
    """First field with enough cleaned text; a heading is added if it names neither number nor ruling."""
    present = F.filter(F.array(*fields), lambda f: f.isNotNull())
    best = F.get(F.filter(F.transform(present, html_to_text), lambda c: F.length(c) >= least), F.lit(0))
    named = F.contains(best, number) | F.contains(F.lower(best), F.lit("dictamen"))
    return F.when(named, best).otherwise(
        F.concat(F.lit("DICTAMEN N° "), number, F.lit(" - "), year, F.lit("\n\n"), best))


def match_search_hit(searches: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit a search meant: id equal to number and year suffix, else the first dated in that year.

    searches ``(search_id, number, year)``, hits ``(search_id, pos, hit_id, hit_date string)``.
    """
    both = hits.join(searches, "search_id")
    plain = F.upper(F.regexp_replace("number", "^0+", ""))
    hit = F.upper("hit_id")
    same = F.endswith(hit, F.concat(F.lit("N"), F.right("year", F.lit(2)))) & (
        F.regexp_replace(F.regexp_replace(hit, r"N\d+$", ""), "^0+", "") == plain)
    tier = F.when(same, 1).when(F.startswith("hit_date", F.col("year")), 2)
    return (
        both.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("search_id")
        .agg(F.min_by(F.struct("hit_id", "tier"), F.struct("tier", "pos")).alias("x"))
        .select("search_id", "x.hit_id", "x.tier")
    )


def pick_best_file(files: DataFrame, keys: list[str]) -> DataFrame:
    """Best file of each document: not a discarded version if possible, scanned copy first, then by source.

    A single aggregate of the smallest (discarded, priority, name): partial per task, so a document with
    very many files costs nothing extra.
    """
    ignored = F.lit(False)
    for word in FILE_IGNORE:
        ignored = ignored | F.contains("name", F.lit(word))
    priority = F.when(F.contains(F.upper("name"), F.lit("OCR")), 0)
    for place, source in enumerate(FILE_SOURCES, start=1):
        priority = priority.when(F.contains("name", F.lit(source)), place)
    order = F.struct(ignored, priority.otherwise(len(FILE_SOURCES) + 1), F.col("name"))
    return files.groupBy(*keys).agg(F.min_by("name", order).alias("name"))
