"""Connected components of a link table, by alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``links`` (a, b) reaches. Nodes without links do not appear.

    In a large star every node hangs its larger neighbours under its least neighbour, in a small star its smaller
    ones; a logarithmic number of rounds leaves one star per component. Each round is a table in the shared folder, minima combine
    before they are shuffled, and a hub's rows are split by Spark's skew join.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = durable(edges, "links"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # every row of ``large`` already points from a larger to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = durable(small.where("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
