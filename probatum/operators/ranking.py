"""Top rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key in the given order.

    ``row_number() <= k`` lets Spark plan WindowGroupLimit: each task keeps k rows per key before the
    shuffle, so a hot key sends only k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
