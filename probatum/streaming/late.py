"""Late rows, kept and counted beside the accepted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import read_or_empty

_MARKS = "newest_us long, accepted long, late long, batch long"


class LateGate:
    """``foreachBatch`` step that splits a stream by a watermark of its own.

    A row is late when its time lies more than ``delay_ms`` before the newest time of all *earlier* micro-batches, or is null.
    Both kinds are written, so accepted and late rows together are the input; what comes after reads ``accepted``. A micro-batch
    writes its rows first and then its mark (newest time and both counts), which commits it: readers leave out batches without a
    mark, and a repeated batch replaces itself and sees only the marks before it.
    """

    def __init__(self, path: str, schema: str, time: Column, delay_ms: int):
        self.path, self.schema, self.time, self.delay_us = path, schema, time, delay_ms * 1000

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = self.marks(spark).where(F.col("batch") < batch_id).agg(F.max("newest_us")).first()[0]
        moment = F.unix_micros(self.time)
        late = moment.isNull() if newest is None else F.coalesce(moment < newest - self.delay_us, F.lit(True))
        folder = f"{self.path}/rows/batch={batch_id}"
        marked = batch.select("*", moment.alias("_moment_us"), late.alias("_late"))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
        written = spark.read.schema(marked.schema).parquet(folder)
        mark = written.agg(F.max("_moment_us").alias("newest_us"), F.count_if(~F.col("_late")).alias("accepted"),
                           F.count_if("_late").alias("late"))
        mark.write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")

    def marks(self, spark: SparkSession) -> DataFrame:
        """One row per micro-batch: newest time, rows accepted and rows late."""
        return read_or_empty(spark, f"{self.path}/marks", _MARKS)

    def _rows(self, spark: SparkSession, late: bool) -> DataFrame:
        rows = read_or_empty(spark, f"{self.path}/rows", f"{self.schema}, _moment_us long, _late boolean, batch long")
        done = self.marks(spark).select("batch")
        return rows.where(F.col("_late") == late).join(done, "batch", "left_semi").drop("_moment_us", "_late", "batch")

    def accepted(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, False)

    def late(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, True)
