"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's target is its weight's share of all words, at most ``repeats`` times its own words; what is cut off goes to the
others by weight. A source is drawn in whole epochs and one part of an epoch. Documents lie in a fixed random order (a hash), cut into blocks;
the part takes the blocks up to a threshold that is found by descending a tree of block totals: 4,096 blocks, then the 4,096 blocks within the
one that straddles the quota, then its few documents. Last, the one document that best fills what is left is added.

The blocks drawn are then dealt to ``shards`` output shards: a binary tree splits each node's exact block quotas in two halves of equal
size, the left half's counts per source following the multivariate hypergeometric law. Shards take disjoint runs of each
source's permuted blocks. :func:`mixture` yields the rows by shard, shuffled within the shard.

A missing source is a source of its own, ordered last; a missing text has no words. Repeated rows are documents of their own. Reruns agree:
all chance comes from hashes. DataFrame functions only; one row per source is all that is ever gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.common import WORD, durable

WEIGHTS = (5, 2, 1)
LEAF = 1 << 39
BLOCKS = 256  # blocks of an epoch that shards are dealt
SMALL = 10_000  # most sources that are broadcast


def size_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(row, doc_id, source, size, u): words per document and its place in the random order, from 0 to 2**63 - 1."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size")).select(
        F.monotonically_increasing_id().alias("row"), "*",
        F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit(seed)), 1).alias("u"))


def targets(sized: DataFrame, weights=WEIGHTS, repeats: int = 3) -> DataFrame:
    """(source, rank, weight, source_size, target) per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.lit(repeats) * F.col("source_size")).cast("double"))
    # sources reach their cap in the order of cap / weight; the level is the one at which the next no longer does
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level")))
        .over(Window.partitionBy())["level"])
    return levels.select("source", "rank", "weight", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _on_source(rows: DataFrame, sources: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Rows with the columns of their source. Few sources are broadcast; else skewed partitions are split by Spark."""
    named = sources.withColumnRenamed("source", "its_source")
    return rows.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("its_source")), how).drop("its_source")


def thresholds(sized: DataFrame, goals: DataFrame, small: bool) -> DataFrame:
    """``goals`` with the last place drawn in the partial epoch (``cut``), the words drawn so, and the row that fills the rest (``extra``)."""
    open_at = goals.select("source", "left").withColumn("low", F.lit(0).cast("long")).withColumn("done", F.lit(0).cast("long"))
    span = 1 << 63
    for width in (1 << 51, LEAF, 0):
        here = _on_source(sized, open_at, small).where((F.col("u") >= F.col("low")) & (F.col("u") - F.col("low") <= F.lit(span - 1)))
        at = F.col("u") if not width else F.floor((F.col("u") - F.col("low")) / F.lit(width)).cast("long")
        totals = here.groupBy("source", at.alias("at")).agg(F.sum("size").alias("words"), F.first("left").alias("left"),
                                                            F.first("done").alias("done"), F.first("low").alias("low"))
        run = totals.withColumn("end", F.col("done") + F.sum("words").over(Window.partitionBy("source").orderBy("at")))
        if width:  # the block that straddles the quota, or the last one
            fits = F.col("end") <= F.col("left")
            step = run.groupBy("source").agg(
                F.first("left").alias("left"), F.first("low").alias("base"),
                F.max(F.when(fits, F.struct("at", "end"))).alias("in"), F.first("done").alias("done"),
                F.min(F.when(~fits, F.col("at"))).alias("over"), F.max("at").alias("last"))
            open_at = step.select("source", "left", (F.col("base") + F.coalesce("over", "last") * F.lit(width)).alias("low"),
                                  F.coalesce("in.end", "done").alias("done"))
            span = width
        else:
            leaf = run.where("end <= left").groupBy("source").agg(F.max("at").alias("cut"), F.max("end").alias("drawn"))
    cuts = _on_source(open_at.select("source", (F.col("low") - 1).alias("low_cut"), F.col("done").alias("low_done")), leaf, small, "left").select(
        "source", F.coalesce("cut", "low_cut").alias("cut"), F.coalesce("drawn", "low_done").alias("drawn"))
    cuts = durable(cuts.join(goals.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "cut", "drawn", (F.col("left") - F.col("drawn")).alias("gap")), "mix-cuts")
    miss = F.abs(F.col("size") - F.col("gap"))
    extra = (_on_source(sized, cuts, small).where((F.col("u") > F.col("cut")) & (miss < F.col("gap")))
             .groupBy("source").agg(F.min_by("row", F.struct(miss, "u", "row")).alias("extra")))
    return _on_source(_on_source(goals, cuts, small), extra, small, "left")


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, rank, count) from (rank, quota: blocks of a source): shards of equal size with the exact quotas in all.

    At each node of the tree the node's blocks are put in random order and half of them go left, so that the left counts per source
    follow the multivariate hypergeometric law and each half is exact. ``shards`` is a power of two. What is ordered is at most ``repeats``
    times ``BLOCKS`` rows per source, however many documents there are.
    """
    blocks = quotas.where("quota > 0").select("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("block"))
    nodes = blocks.withColumn("shard", F.lit(0).cast("long"))
    for depth in range(int(math.log2(shards))):
        node = Window.partitionBy("shard")
        place = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(depth), "rank", "block"), "rank", "block"))
        right = place > F.floor(F.count("*").over(node) / 2)
        nodes = nodes.select("rank", "block", (F.col("shard") * 2 + F.when(right, 1).otherwise(0)).alias("shard"))
    return nodes.groupBy("shard", "rank").agg(F.count("*").alias("count"))


def plan_mixture(docs: DataFrame, weights=WEIGHTS, repeats: int = 3, shards: int = 16, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards) per document.

    ``taken`` counts the words the mix takes, repeats included; ``shards`` has the output shard of each time it is taken.
    """
    sized = durable(size_documents(docs, seed), "mix-sizes")
    goals = durable(targets(sized, weights, repeats).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    small = goals.count() <= SMALL
    plan = durable(thresholds(sized, goals, small), "mix-plan")
    block = (1 << 63) // BLOCKS
    last = F.greatest(F.floor(F.col("cut") / F.lit(block)), F.lit(0)).cast("long")
    plan = plan.withColumn("last", last).withColumn("quota", F.col("epochs") * BLOCKS + F.when(
        (F.col("cut") >= 0) | F.col("extra").isNotNull(), F.col("last") + 1).otherwise(0))
    dealt = split_quotas(plan.select("rank", "quota"), shards, seed)
    of_source = F.map_from_entries(F.collect_list(F.struct("shard", "count")))
    upto = dealt.groupBy("rank").agg(of_source.alias("of")).select("rank", F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), F.array().cast("array<bigint>"),
        lambda a, i: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.coalesce(F.try_element_at("of", i), F.lit(0))))).alias("upto"))
    plan = durable(plan.join(upto, "rank", "left").withColumn("upto", F.coalesce("upto", F.array().cast("array<bigint>"))), "mix-shards")
    rows = _on_source(sized, plan, small)
    part = (F.col("u") <= F.col("cut")) | F.coalesce(F.col("row") == F.col("extra"), F.lit(False))
    times = F.col("epochs") + F.when(part, 1).otherwise(0)
    own = F.floor(F.col("u") / F.lit(block)).cast("long")

    def shard_of(epoch: Column) -> Column:
        place = epoch * BLOCKS + F.when(epoch < F.col("epochs"), own).otherwise(F.least(own, F.col("last")))
        return F.size(F.filter("upto", lambda x: x <= place))

    drawn = F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), shard_of)).otherwise(F.array().cast("array<int>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"), drawn.alias("shards"))


def mixture(plan: DataFrame, seed: int = 0) -> DataFrame:
    """One row (shard, place, doc_id, ...) each time a document is taken, gathered by shard and shuffled within it."""
    each = plan.select("*", F.posexplode("shards").alias("time", "shard")).drop("shards")
    placed = each.withColumn("place", F.xxhash64("doc_id", "time", "shard", F.lit(seed)))
    return placed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
