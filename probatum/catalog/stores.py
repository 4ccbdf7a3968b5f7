"""Sources and keyed changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import readers, upserts
from . import derived as d
from .registry import query

TODAY = "2026-01-15"


@query("scan_documents", """
SELECT doc_id, lang, length(text) AS chars, sha256(text) AS hash, 'documents.parquet' AS archivo FROM documents""")
def scan_documents(t):
    docs = readers.scan_documents(t.spark, f"{t.sf_dir}/documents.parquet", whole_column="text")
    return docs.select("doc_id", "lang", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("hash"),
                       readers.table_name(F.col("path")).alias("archivo"))


@query("scan_csv_inventory", """
SELECT p_partkey || '.pdf' AS archivo, p_retailprice AS tamano_kb, md5(p_name || ', "' || p_type || '"' || chr(10) || p_brand) AS md5,
  p_name || ', "' || p_type || '"' || chr(10) || p_brand AS materia FROM part""")
def scan_csv_inventory(t):
    subject = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\n'), "p_brand")
    rows = t.part.select(
        F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("archivo"), F.col("p_retailprice").alias("tamano_kb"),
        F.md5(subject).alias("md5"), subject.alias("materia"))
    path = scratch_path(t.spark, "inventory")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return readers.scan_inventory(t.spark, path, "archivo string, tamano_kb double, md5 string, materia string")


@query("scan_json_manifest", """
SELECT doc_id, 'LEY-' || doc_id AS key, 'LEY' AS tipo, CAST(doc_id AS VARCHAR) AS numero, length(text) AS chars FROM documents WHERE doc_id % 4 <> 2
UNION ALL SELECT doc_id, 'DDU-' || doc_id, 'DDU', CAST(doc_id AS VARCHAR), length(text) FROM documents WHERE doc_id % 4 <> 2""")
def scan_json_manifest(t):
    i = F.col("doc_id").cast("string")

    def entry(kind: str):
        return F.struct(F.lit(kind).alias("tipo"), i.alias("numero"), F.length("text").cast("long").alias("chars"))

    text = F.to_json(F.create_map(F.concat(F.lit("LEY-"), i), entry("LEY"), F.concat(F.lit("DDU-"), i), entry("DDU")))
    broken = F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("not json "), text)).otherwise(text)
    return readers.explode_manifest(t.documents.select("doc_id", broken.alias("value"))).select("doc_id", "key", "tipo", "numero", "chars")


KINDS = ["Decreto con Fuerza de Ley", "DFL 458", "Decreto Ley", "dl 1939", "Decreto Supremo", "DS 47", "Ley", "Resolución"]
TYPES = ["DFL", "DFL", "DL", "DL", "DS", "DS", "LEY", "LEY"]


@query("build_manifest", d.with_("", f"""
SELECT key, tipo, archivo, url_fuente, titulo, fecha_publicacion FROM (
  SELECT *, tipo || '-' || numero AS key, row_number() OVER (PARTITION BY tipo || '-' || numero ORDER BY path) AS n FROM records)
WHERE n = 1 AND key NOT IN (SELECT 'LEY-' || p_partkey FROM part)""", {"records": f"""
SELECT {d.sql_pick(TYPES, 'p_partkey')} AS tipo, CAST(p_partkey // 16 AS VARCHAR) AS numero, 'n/' || p_partkey AS path, 'n/' || p_partkey || '.txt' AS archivo,
  CASE WHEN p_partkey % 3 = 0 THEN 'https://www.bcn.cl/leychile/' ELSE 'https://x.example/' || p_partkey END AS url_fuente, p_name AS titulo,
  CASE WHEN p_partkey % 5 <> 0 THEN (1980 + p_size) || '-01-01' END AS fecha_publicacion FROM part WHERE p_partkey % 7 <> 0"""}))
def build_manifest(t):
    i = F.col("p_partkey")
    key = i.cast("string")
    metadata = t.part.select(
        F.concat(F.lit("n/"), key).alias("path"), d.pick(KINDS, i).alias("tipo_norma"), F.floor(i / 16).cast("string").alias("numero"),
        F.col("p_name").alias("titulo_oficial"), F.when(i % 5 != 0, (F.col("p_size") + 1980).cast("string")).otherwise("").alias("anio"),
        F.when(i % 3 != 0, F.concat(F.lit("https://x.example/"), key)).alias("url"))
    texts = t.part.where(i % 7 != 0).select(F.concat(F.lit("n/"), key).alias("path"), F.concat(F.lit("n/"), key, F.lit(".txt")).alias("archivo"))
    known = t.part.select(F.concat(F.lit("LEY-"), key).alias("key"))
    return readers.build_manifest(metadata, texts, known)


KEY_SHAPES = ["LGUC", "OGUC", "DDU-ESP-", "DDU-", "LEY-", "DFL-", "DL-", "DS-", "CGR-", "RES-"]


def keys(t):
    i = F.col("p_partkey")
    tail = F.when(i % 10 < 2, "").when(i % 10 == 2, F.concat(F.lpad(i.cast("string"), 6, "0"), F.lit("-07"))).when(
        i % 10 == 8, F.concat(F.lit("E"), i.cast("string"), F.lit("-2006"))).otherwise(i.cast("string"))
    return t.part.select("p_partkey", F.concat(d.pick(KEY_SHAPES, i), tail).alias("key"))


_KEYS = {"keys": f"""
SELECT p_partkey, {d.sql_pick(KEY_SHAPES, 'p_partkey')} || CASE WHEN p_partkey % 10 < 2 THEN '' WHEN p_partkey % 10 = 2 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-07'
  WHEN p_partkey % 10 = 8 THEN 'E' || p_partkey || '-2006' ELSE CAST(p_partkey AS VARCHAR) END AS key FROM part"""}
_KIND_OF = """CASE p_partkey % 10 WHEN 0 THEN 'LGUC' WHEN 1 THEN 'OGUC' WHEN 2 THEN 'DDU_ESPECIFICA' WHEN 3 THEN 'DDU' WHEN 4 THEN 'LEY' WHEN 5 THEN 'DFL'
  WHEN 6 THEN 'DL' WHEN 7 THEN 'DS' WHEN 8 THEN 'CGR' ELSE 'DDU' END"""


@query("doc_type_from_key", d.with_("", f"SELECT p_partkey, key, {_KIND_OF} AS tipo FROM keys", _KEYS))
def doc_type_from_key(t):
    return keys(t).withColumn("tipo", readers.doc_type_from_key(F.col("key")))


@query("key_parts", d.with_("", f"""
SELECT p_partkey, {_KIND_OF} AS tipo, CASE WHEN p_partkey % 10 < 2 THEN '' WHEN p_partkey % 10 = 2 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-07'
  WHEN p_partkey % 10 = 8 THEN 'E' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS numero, CASE WHEN p_partkey % 10 = 8 THEN '2006' END AS anio FROM keys""", _KEYS))
def key_parts(t):
    return keys(t).select("p_partkey", readers.key_parts(F.col("key")).alias("k")).select("p_partkey", "k.*")


def stored_norms(t):
    i = F.col("doc_id")
    return d.norms(t).where(i % 3 != 0).select(
        "tipo", "numero", "titulo", F.lit("old").alias("url_fuente"), F.lit("2000-01-01").alias("fecha_publicacion"), F.lit("h0").alias("hash_contenido"),
        F.lit("2001-01-01").alias("fecha_actualizacion"), "vigente")


@query("upsert_documents", d.with_("norms", f"""
SELECT n.tipo, n.numero, CASE WHEN i THEN 'T' || n.doc_id ELSE n.titulo END AS titulo, CASE WHEN i THEN 'new' ELSE 'old' END AS url_fuente,
  CASE WHEN NOT i THEN '2000-01-01' END AS fecha_publicacion, CASE WHEN i THEN sha256(t.text) ELSE 'h0' END AS hash_contenido,
  CASE WHEN i THEN '{TODAY}' ELSE '2001-01-01' END AS fecha_actualizacion, i OR n.vigente AS vigente
FROM (SELECT *, doc_id % 2 = 0 AS i FROM norms) n JOIN documents t ON t.doc_id = n.doc_id WHERE i OR n.doc_id % 3 <> 0"""))
def upsert_documents(t):
    i = F.col("doc_id")
    hashes = t.documents.select("doc_id", F.sha2("text", 256).alias("hash_contenido"))
    incoming = d.norms(t).where(i % 2 == 0).join(hashes, "doc_id").select(
        "tipo", "numero", F.concat(F.lit("T"), i.cast("string")).alias("titulo"), F.lit("new").alias("url_fuente"),
        F.lit(None).cast("string").alias("fecha_publicacion"), "hash_contenido")
    return upserts.upsert_documents(stored_norms(t), incoming, F.lit(TODAY))


@query("replace_chunks", d.with_("passages", """
SELECT doc_id, chunk_id, texto FROM passages WHERE doc_id % 3 <> 1
UNION ALL SELECT doc_id, chunk_id, 'N:' || texto FROM passages WHERE doc_id % 3 = 1 AND orden % 2 = 0"""))
def replace_chunks(t):
    p = d.passages(t).select("doc_id", "chunk_id", "orden", "texto")
    fresh = p.where((F.col("doc_id") % 3 == 1) & (F.col("orden") % 2 == 0)).withColumn(
        "texto", F.concat(F.lit("N\u0000:"), "texto"))
    return upserts.replace_chunks(p.select("doc_id", "chunk_id", "texto"), fresh)


@query("cascade_delete", d.with_("passages", """
SELECT doc_id, count(*) AS chunks FROM passages WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id"""))
def cascade_delete(t):
    removed = t.labels.where("toxic = 1").select("doc_id")
    norms, chunks = upserts.cascade_delete(d.norms(t).select("doc_id"), d.passages(t).select("doc_id", "chunk_id"), removed)
    return norms.join(chunks, "doc_id").groupBy("doc_id").agg(F.count("chunk_id").alias("chunks"))


@query("set_validity", d.with_("norms", f"""
SELECT n.doc_id, CASE WHEN l.doc_id IS NULL THEN n.vigente ELSE l.toxic = 0 END AS vigente, CASE WHEN l.doc_id IS NULL THEN '2001-01-01' ELSE '{TODAY}' END AS fecha_actualizacion
FROM norms n LEFT JOIN labels l ON l.doc_id = n.doc_id"""))
def set_validity(t):
    changes = t.labels.select("doc_id", F.when(F.col("toxic") == 0, "true").otherwise("no").alias("vigente"))
    stored = d.norms(t).select("doc_id", "vigente", F.lit("2001-01-01").alias("fecha_actualizacion"))
    return upserts.set_validity(stored, changes, F.lit(TODAY))


@query("append_query_log", d.with_("evidence answers", """
SELECT a.query_id, a.conv_id AS user_id, e.usados, e.n FROM answers a LEFT JOIN (
  SELECT query_id, string_agg(chunk_id || '/' || norma || '/' || coalesce(articulo, '-'), ' ' ORDER BY rank) AS usados, CAST(count(*) AS INTEGER) AS n FROM evidence GROUP BY query_id) e
ON e.query_id = a.query_id"""))
def append_query_log(t):
    answered = d.answers(t).select(
        "query_id", F.col("conv_id").alias("user_id"), F.to_timestamp(F.lit("2026-01-15 10:00:00")).alias("created_at"))
    rows = upserts.query_log_rows(answered, d.evidence(t).withColumn("similarity", F.lit(1.0) / F.col("rank")))
    path = scratch_path(t.spark, "query-log")
    upserts.append_log(rows, path)
    used = F.transform("chunks_usados", lambda c: F.concat_ws("/", c["id"].cast("string"), c["norma"], F.coalesce(c["articulo"], F.lit("-"))))
    stored = t.spark.read.parquet(path)
    return stored.select("query_id", "user_id", F.array_join(used, " ").alias("usados"), F.when(
        F.col("chunks_usados").isNotNull(), F.size("chunks_usados")).alias("n"))


@query("apply_feedback", """
SELECT e.event_id AS id, coalesce(v.voto, e.event_id % 3 = 0) AS feedback FROM events e LEFT JOIN (
  SELECT event_id AS id, toxic = 0 AS voto FROM (SELECT doc_id AS event_id, toxic FROM labels WHERE quality = 1)) v ON v.id = e.event_id""")
def apply_feedback(t):
    log = t.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("feedback"))
    value = F.when(F.col("toxic") == 0, 1).otherwise(-1)
    votes = t.labels.select(F.col("doc_id").alias("id"), F.explode(F.array(
        F.struct((-value).alias("value"), F.lit(1).alias("at")), F.struct(F.when(F.col("quality") == 1, value).otherwise(5).alias("value"), F.lit(2).alias("at"))))
        .alias("v")).where("quality = 1 OR v.value = 5").select("id", "v.*")
    return upserts.apply_feedback(log, votes)


_SUBS = """
SELECT o_custkey AS user_id, 's' || o_orderkey AS sub_id, CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 'pro' ELSE 'free' END AS plan_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'canceled' WHEN o_orderstatus = 'F' THEN 'active' ELSE 'past_due' END AS status,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS period_end
FROM orders WHERE o_orderkey % 17 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def subscription_events(t):
    i = F.col("o_orderkey")
    return t.orders.select(
        i.alias("event_id"), F.col("o_orderdate").alias("at"), F.when(i % 17 != 0, F.col("o_custkey")).alias("user_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "deleted").when(i % 2 == 0, "updated").otherwise("created").alias("type"),
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("past_due").alias("status"), F.concat(F.lit("s"), i.cast("string")).alias("sub_id"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd").alias("period_end"))


@query("subscription_latest", _SUBS)
def subscription_latest(t):
    return upserts.subscription_latest(subscription_events(t))


@query("profile_from_signup", """
SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@x.example' AS email,
  CASE WHEN c_custkey % 2 = 0 THEN 'N-' || c_custkey ELSE lower(replace(c_name, '#', '.')) END AS nombre, 'beta' AS plan FROM customer WHERE c_custkey % 5 <> 0""")
def profile_from_signup(t):
    i = F.col("c_custkey")
    meta = F.when(i % 2 == 0, F.to_json(F.struct(F.concat(F.lit("N-"), i.cast("string")).alias("nombre")))).otherwise("{}")
    signups = t.customer.select(
        i.alias("id"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@x.example")).alias("email"), meta.alias("metadata"))
    return upserts.profile_from_signup(t.customer.where(i % 5 == 0).select(i.alias("id")), signups)
