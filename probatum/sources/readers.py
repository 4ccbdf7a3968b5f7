"""Readers of documents, inventories and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lookups.norms import DEFAULT_SOURCE_URL, KEY_FALLBACK, KEY_PREFIXES, KEY_WHOLE, TYPE_MARKER_FALLBACK, TYPE_MARKERS

# Headers of the inventory files.
INVENTORIES = {
    "official_index": "ddu_numero string, materia string, tamano_pdf string",
    "downloads": "ddu_numero string, estado string, archivo_guardado string, url string",
    "pending": "ddu_numero string, estado string, archivo_guardado string, url string",
    "retries": "ddu_numero string, estado string, url string, archivo string, http_status string, detalle string",
    "file_hashes": "archivo string, tamano_kb double, md5 string",
    "master_index": "id string, categoria string, subcategoria string, tipo_norma string, numero string, anio string, organismo string, "
                    "titulo string, nombre_corto string, fuente_principal string, url string, archivo_local string, estado string, observaciones string",
}

MANIFEST_ENTRY = ("tipo string, numero string, titulo string, url_fuente string, fecha_descarga string, hash string, archivo string, "
                  "chars bigint, paginas int, fecha_publicacion string")


def scan_documents(spark: SparkSession, path: str, pattern: str = "*.txt", whole_column: str | None = None) -> DataFrame:
    """Documents ``(path, text)``: one row per text file below a folder, or per row of a parquet table."""
    if whole_column:
        return spark.read.parquet(path).withColumn("path", F.col("_metadata.file_path")).withColumnRenamed(whole_column, "text")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def table_name(path: Column) -> Column:
    """Name of the parquet table a file belongs to: its own, or that of the folder that holds the table's files."""
    return F.regexp_extract(path, r"/([^/]+\.parquet)(?:/.*)?$", 1)


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata records: every ``metadata.json`` in a ``03_metadatos`` folder; broken files are skipped."""
    schema = ("titulo_oficial string, nombre_corto string, tipo_norma string, numero string, anio string, organismo string, url string, "
              "_corrupt_record string")
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metadata.json").select(
        F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("m"))
    return raw.where(F.col("path").rlike(r"/\d{2}_[^/]*/.*03_metadatos/metadata\.json$") & F.col("m._corrupt_record").isNull()).select(
        "path", "m.*").drop("_corrupt_record")


def scan_inventory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A header CSV with a declared schema, quoted fields over several lines, with or without a byte order mark.

    ``schema`` is a name in ``INVENTORIES`` or a DDL string. Columns are taken by position, so a mark before the
    first header name does no harm.
    """
    return spark.read.csv(path, header=True, schema=INVENTORIES.get(schema, schema), quote='"', escape='"', multiLine=True,
                          enforceSchema=True, mode="PERMISSIVE")


def explode_manifest(manifests: DataFrame, column: str = "value") -> DataFrame:
    """JSON objects key -> entry as rows; text that is no such object gives no rows."""
    parsed = F.from_json(F.col(column), f"map<string,struct<{_fields()}>>")
    keep = [c for c in manifests.columns if c != column]
    return manifests.select(*keep, F.explode(parsed).alias("key", "entry")).select(*keep, "key", "entry.*")


def _fields() -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in MANIFEST_ENTRY.split(","))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    return explode_manifest(spark.read.text(path, wholetext=True))


def infer_type(free_text):
    """Document type from a free description, by the first marker it contains."""
    text, chain = F.upper(free_text), F
    for kind, markers in TYPE_MARKERS:
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(text, F.lit(marker))
        chain = chain.when(hit, kind)
    return chain.otherwise(TYPE_MARKER_FALLBACK)


def doc_type_from_key(key):
    chain = F.when(key.isin(*KEY_WHOLE), key)
    for prefix, kind in KEY_PREFIXES:
        chain = chain.when(F.startswith(key, F.lit(prefix)), kind)
    return chain.otherwise(KEY_FALLBACK)


def key_parts(key):
    """``(tipo, numero, anio)`` of a document key; the year only for rulings."""
    kind = doc_type_from_key(key)
    rest = F.array_join(F.slice(F.split(key, "-"), F.lit(2), F.greatest(F.size(F.split(key, "-")) - 1, F.lit(0))), "-")
    number = (
        F.when(kind == "DDU_ESPECIFICA", F.regexp_replace(key, "^DDU-ESP-", ""))
        .when(kind == "CGR", F.regexp_replace(rest, "-[^-]*$", "")).otherwise(rest))
    year = F.when(kind == "CGR", F.regexp_extract(key, "-([^-]*)$", 1))
    return F.struct(kind.alias("tipo"), number.alias("numero"), year.alias("anio"))


def build_manifest(metadata: DataFrame, texts: DataFrame, manifest: DataFrame) -> DataFrame:
    """New manifest entries: metadata with an extracted text whose key is not yet known, first path winning.

    metadata ``(path, tipo_norma, numero, titulo_oficial, anio, url)``, texts ``(path, archivo)``, manifest ``(key)``.
    """
    kind = infer_type(F.col("tipo_norma"))
    keyed = metadata.join(texts, "path").select(
        F.concat_ws("-", kind, "numero").alias("key"), kind.alias("tipo"), "path", "archivo",
        F.coalesce(F.nullif("url", F.lit("")), F.lit(DEFAULT_SOURCE_URL)).alias("url_fuente"), F.col("titulo_oficial").alias("titulo"),
        F.when(F.col("anio") != "", F.concat("anio", F.lit("-01-01"))).alias("fecha_publicacion"))
    fresh = keyed.join(manifest.select("key"), "key", "left_anti")
    rest = ["tipo", "archivo", "url_fuente", "titulo", "fecha_publicacion"]
    return fresh.groupBy("key").agg(F.min_by(F.struct(*rest), "path").alias("e")).select("key", "e.*")
