"""Incremental corpus build: changed documents to sections, chunks and full-text index, in one run folder.

Every run writes its own folder and the state last. A chunk counts only if the state names its run, so a
run that dies half-way leaves the corpus as it was, and repeating it overwrites the same folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import MAX_TOKENS, OVERLAP_TOKENS, chunk_documents
from ..operators.cleaning import clean_text
from ..operators.fulltext import Index, build_index
from ..operators.segmentation import sections_by_type
from ..operators.stateful import hash_change_detect
from ..functions.text import PARAGRAPH_BREAK
from ..streaming.jobs import KeyedTable

STATE_SCHEMA = "key string, hash string, run long"


@dataclass
class Corpus:
    """Tables of a corpus below one folder."""

    spark: SparkSession
    root: str

    @property
    def state(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/state", STATE_SCHEMA, ["key"], ["run"])

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def chunks(self) -> DataFrame:
        """Current chunks: those of the run the state names for their document."""
        current = self.state.read(self.spark).select(F.col("key").alias("doc_key"), "run")
        return self._table("chunks").join(current, ["doc_key", "run"], "left_semi")

    def index(self) -> Index:
        """Full-text index of the current chunks."""
        return Index.of(self._table("index/*/chunks").join(self.chunks().select("chunk_id"), "chunk_id", "left_semi"))


def ingest(
    corpus: Corpus, docs: DataFrame, run: int, *, force: bool = False, max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP_TOKENS, paragraph: str = PARAGRAPH_BREAK, sections=None,
) -> DataFrame:
    """Ingest documents ``(key, tipo, numero, url, text)`` and optionally ``titulo``; returns what was done per status.

    Only new and changed documents are cut and written; they are found, and their hashes worked out, once. ``sections`` maps the
    text column to an array of sections; by default the layout follows each document's type.
    """
    spark = corpus.spark
    state = corpus.state.read(spark, before=run)
    title = F.col("titulo") if "titulo" in docs.columns else F.lit(None).cast("string")
    changed = hash_change_detect(docs.withColumn("titulo", title), state, force)
    todo_path = f"{corpus.root}/todo/run={run}"
    changed.select("key", "tipo", "numero", "titulo", "url", "text", "hash").write.mode("overwrite").parquet(todo_path)
    todo = spark.read.parquet(todo_path)
    cut = sections or (lambda text: sections_by_type(F.col("tipo"), F.col("numero"), F.col("titulo"), clean_text(text, "law")))
    keyed = todo.withColumnRenamed("key", "doc_id").withColumn("texto", F.col("text"))
    chunks = chunk_documents(keyed, cut(F.col("texto")), max_tokens, overlap, paragraph)
    named = chunks.withColumnRenamed("doc_id", "doc_key").withColumn("run", F.lit(run).cast("long")).withColumn(
        "chunk_id", F.concat_ws("#", "doc_key", F.col("run").cast("string"), F.col("orden").cast("string")))
    path = f"{corpus.root}/chunks/run={run}"
    named.drop("run").write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    build_index(written).write(f"{corpus.root}/index/run={run}")
    seen = docs.select(F.count("*")).scalar()
    stored = written.groupBy(F.col("doc_key").alias("key")).agg(F.count("*").alias("chunks"))
    done = todo.select("key", "hash").join(stored, "key", "left")
    corpus.state.append(done.select("key", "hash", F.lit(run).cast("long").alias("run")), run)
    return done.agg(
        F.count("*").alias("procesados"), (seen - F.count("*")).alias("sin_cambio"), F.count("chunks").alias("con_chunks"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
