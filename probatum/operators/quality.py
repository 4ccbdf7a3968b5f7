"""Corpus and inventory quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lookups.norms import MIN_CHARS, MIN_CHARS_DEFAULT


def verify_corpus(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """First failing check of each manifest entry: missing file, other hash, too short, or ok.

    manifest ``(key, tipo, hash)``, files ``(key, text)``.
    """
    least = F
    for kind, chars in MIN_CHARS.items():
        least = least.when(F.col("tipo") == kind, F.lit(chars))
    least = least.otherwise(F.lit(MIN_CHARS_DEFAULT))
    checked = manifest.join(files.select("key", F.sha2("text", 256).alias("actual"), F.length("text").alias("chars")), "key", "left")
    status = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("hash"), "hash_mismatch")
        .when(F.col("chars") < least, "too_short").otherwise("ok"))
    return checked.select("key", "tipo", status.alias("estado"), "chars")


def verification_totals(verified: DataFrame) -> DataFrame:
    return verified.groupBy("estado").agg(F.count("*").alias("n"))


def duplicate_files(files: DataFrame) -> DataFrame:
    """Contents that stand under several names: ``(md5, copias, primero)``. Only counts and the smallest name travel."""
    counts = files.groupBy("md5").agg(F.count("*").alias("copias"), F.min("archivo").alias("primero"))
    return counts.where("copias > 1")


def copies_of(files: DataFrame) -> DataFrame:
    """Every file that has a copy, as a row with the number of copies and their first name; no group is gathered."""
    return files.join(duplicate_files(files), "md5")


def canonical_key(tipo: Column, numero: Column) -> Column:
    """Type in capitals and number without a year suffix."""
    return F.concat_ws("-", F.upper(tipo), F.regexp_replace(numero, r"-\d{4}$", ""))


def duplicate_documents(docs: DataFrame) -> DataFrame:
    """Documents that repeat another under a variant of its key: ``(doc_id, keep_id)``.

    The one with most chunks is kept. docs ``(doc_id, tipo, numero, chunks)``.
    """
    keyed = docs.withColumn("clave", canonical_key(F.col("tipo"), F.col("numero")))
    best = keyed.groupBy("clave").agg(
        F.count("*").alias("variantes"), F.max_by("doc_id", F.struct("chunks", -F.col("doc_id"))).alias("keep_id"))
    return keyed.join(best.where("variantes > 1"), "clave").where("doc_id <> keep_id").select("doc_id", "clave", "keep_id")


def missing_ranges(numbers: DataFrame) -> DataFrame:
    """Gaps in the numbers of each group: ``(grupo, desde, hasta, faltan)`` from the gap to the next number.

    ``numbers (grupo, n)``. The next number is found within blocks of the number line and block
    boundaries are bridged on one row per block, so one large group is spread over many tasks.
    """
    width = 100_000
    placed = numbers.select("grupo", F.col("n").cast("long").alias("n")).distinct().withColumn("block", F.floor(F.col("n") / width))
    inside = placed.withColumn("next", F.lead("n").over(Window.partitionBy("grupo", "block").orderBy("n")))
    blocks = placed.groupBy("grupo", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    bridged = blocks.withColumn("next", F.lead("lo").over(Window.partitionBy("grupo").orderBy("block"))).select(
        "grupo", F.col("hi").alias("n"), "next")
    steps = inside.where("next IS NOT NULL").select("grupo", "n", "next").unionByName(bridged.where("next IS NOT NULL"))
    return steps.where(F.col("next") > F.col("n") + 1).select(
        "grupo", (F.col("n") + 1).alias("desde"), (F.col("next") - 1).alias("hasta"), (F.col("next") - F.col("n") - 1).alias("faltan"))


def inventory_reconcile(official: DataFrame, downloads: DataFrame, retries: DataFrame) -> DataFrame:
    """State of each number over index, downloads and retries: the retry wins, then the download, else missing.

    official ``(numero)``, downloads ``(numero, estado)``, retries ``(numero, estado, intento)``.
    """
    last = retries.groupBy("numero").agg(F.max_by("estado", "intento").alias("reintento"))
    both = official.select("numero", F.lit(True).alias("en_indice")).join(
        downloads.select("numero", F.col("estado").alias("descarga")), "numero", "full_outer").join(last, "numero", "full_outer")
    return both.select(
        "numero", F.coalesce("en_indice", F.lit(False)).alias("en_indice"),
        F.coalesce("reintento", "descarga", F.lit("missing")).alias("estado"))


def parse_size(col: Column) -> Column:
    """``4853Kb`` as a number of kilobytes."""
    number = F.replace(F.regexp_extract(col, r"(?i)^\s*([\d.,]+)\s*[kmg]b", 1), F.lit(","), F.lit("."))
    unit = F.lower(F.regexp_extract(col, r"(?i)([kmg])b", 1))
    scale = F.when(unit == "m", 1024.0).when(unit == "g", 1048576.0).otherwise(1.0)
    return F.nullif(number, F.lit("")).cast("double") * scale


def inventory_counts(inventory: DataFrame) -> DataFrame:
    """Entries by category, type and state, with all subtotals."""
    return inventory.cube("categoria", "tipo_norma", "estado").agg(F.count("*").alias("n")).select(
        *[F.coalesce(c, F.lit("*")).alias(c) for c in ("categoria", "tipo_norma", "estado")], "n")


def too_few_chunks(docs: DataFrame, least: int = 16, chars: int = 0) -> DataFrame:
    """Documents whose number of chunks is suspiciously low: ``(doc_id, chunks)``."""
    return docs.where((F.col("chunks") < least) & (F.col("chars") >= chars)).select("doc_id", "chunks", "chars")
