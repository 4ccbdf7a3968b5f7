"""Shared helpers of the training-data operators: words, fingerprints, packed exchanges and durable tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
LAST = np.iinfo(np.int64).max
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. A temporary one is used in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors never replay what lies before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Let rows with texts travel between Spark and Python in batches of at most 2,000 rows and ``most`` bytes, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def shares(spark: SparkSession, size: int, each: int) -> int:
    """Into how many groups ``size`` units are dealt, so that none holds much more than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


class Hashes(dict):
    """64-bit hashes of byte strings, remembered up to a fixed number of entries."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters outside ``\\x20\\x09-\\x0D`` as UTF-8; ``lower`` lower-cases A-Z only."""
    if not text:
        return []
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, a number for each word (equal words have the same), and the distinct words by number.

    The same words as :func:`words` with A-Z lower-cased, cut and counted by Arrow without an object per word.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string()))))
    sizes, flat = cut.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), cut.flatten()
    blank = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # a text without words is cut into one empty string
    if blank.any():
        sizes[np.repeat(np.arange(len(sizes)), sizes)[blank]] = 0
        flat = flat.filter(pa.array(~blank))
    coded = flat.dictionary_encode()
    return sizes, coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(33)
    h *= M1
    h ^= h >> np.uint64(33)
    h *= M2
    h ^= h >> np.uint64(33)
    return h


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive values."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= STEP
        out += h[j:j + n]
    return mix(out)


def shingle_hashes(text: str | None, hashes: Hashes, size: int = 5) -> np.ndarray:
    """Hashes of the word shingles of a lower-cased text, in order; fewer words make one shingle, no words none."""
    found = words(text, True)
    if not found:
        return np.empty(0, np.uint64)
    h = hashes.of(found)
    return windows(h, min(size, len(h)))


def edges(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the 64-bit space begins in a sorted array (parts + 1 positions)."""
    starts = np.array([(i << 64) // parts for i in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, starts), len(sorted_hashes))


def key_of(id_column: str = "doc_id"):
    """An integer id, a missing one as the largest."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(LAST))


def id_of(key: str = "key"):
    """The inverse of :func:`key_of`."""
    return F.nullif(F.col(key), F.lit(LAST))


def text_mark():
    """A hash of the text; with the key it names a row, or rows that are alike."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def batched(docs: DataFrame, batches: int, carried: list[str] | tuple = ()) -> DataFrame:
    """The key and text of each row, with the batch that id and text deal it to. Columns to be carried along travel as JSON."""
    rest = F.to_json(F.struct(*carried), {"ignoreNullFields": "false"} | EXACT_TIMES) if carried else F.lit("")
    return docs.select(rest.alias("rest"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), F.lit(batches)).cast("int").alias("batch"),
                       key_of().alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def in_order(pdf):
    """A batch's rows in an order that does not depend on how they arrived."""
    return pdf.sort_values(["key", "text"], kind="stable").reset_index(drop=True)


BITS = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()),
                     T.StructField("bits", T.BinaryType())])
