"""A training corpus from ``documents``: quality, near copies, repeated passages, benchmark passages, mixture.

Each stage takes what the one before it kept, as it was written and read back, and returns the columns of ``documents``; the
last returns the mixture: a row each time a document is taken, by output shard and place within it.

Other columns of ``documents`` may have any names and pass unchanged. Batches, shards and blocks are smaller than those of the
operators alone, as the stages share their executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.common import EXACT_TIMES, WORD, durable, key_of, small_batches, text_mark
from probatum.llm.mixing import mixture, plan_mixture
from probatum.llm.nbsvm import judge
from probatum.llm.ngram_join import join_documents
from probatum.llm.positional import decontaminate
from probatum.llm.suffix_index import dedup_suffixes

ARROW_BYTES, REPEAT_BYTES, RANGE_BYTES, SHARD_WORDS = 2 << 20, 4 << 20, 16 << 20, 1 << 18

ORACLE_SQL = None  # SQL cannot fit the classifier


def _named(docs: DataFrame) -> DataFrame:
    """Rows with the id and text mark that name them, apart from columns of whatever names."""
    return docs.select(F.struct("*").alias("all"), key_of().alias("key"), text_mark().alias("mark"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Labels of a quarter of the ids are kept out of the fit, as in op2."""
    small_batches(spark, ARROW_BYTES)
    judged = judge(docs.select("doc_id", "text", F.struct("*").alias("all")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("predicted = 1").select("all.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id. Documents without words are in no group."""
    small_batches(spark, ARROW_BYTES)
    rows = join_documents(docs).where("group is not null").select(key_of().alias("key"), "text_mark", "group")
    first = rows.groupBy("group").agg(F.min(F.struct("key", "text_mark")).alias("first")).select("first.*")
    has_words = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    chosen = _named(docs.where(has_words)).join(first.withColumnRenamed("text_mark", "mark"), ["key", "mark"], "left_semi")
    return chosen.dropDuplicates(["key", "mark"]).select("all.*").unionByName(docs.where(~has_words))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat; a character cut in two goes whole. n_chars follows the text."""
    small_batches(spark, ARROW_BYTES)
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others).schema
    kept = dedup_suffixes(docs, carried=others, whole_characters=True, batch_bytes=REPEAT_BYTES, part_bytes=RANGE_BYTES)
    out = kept.select(F.from_json("rest", schema, EXACT_TIMES).alias("rest"), F.decode("kept", "UTF-8").alias("text")).select("rest.*", "text")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    small_batches(spark, ARROW_BYTES)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shard_words=SHARD_WORDS)
    bad = found.where("contaminated").select(key_of().alias("key"), "mark").distinct()
    return _named(docs).join(bad, ["key", "mark"], "left_anti").select("all.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as they are mixed: one row each time one is taken, shuffled within its shard."""
    return mixture(plan_mixture(docs))


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("repeated_passages", cut_repeats),
          ("benchmark_passages", drop_contaminated), ("mixture", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
