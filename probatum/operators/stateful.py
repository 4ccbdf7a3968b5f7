"""State-carrying and change-tracking jobs in batch form; the streaming forms are in ``streaming``."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
CHANGE_THRESHOLD = 500
DECISION_SCHEMA = "client string, event_id long, allowed boolean, remaining int, reset_ms long"


class SlidingLog:
    """Accepted request times of one client: at most ``limit`` entries."""

    def __init__(self, limit: int, window_ms: int, accepted: list[int] | None = None):
        self.limit, self.window_ms = limit, window_ms
        self.accepted: deque[int] = deque(accepted or [])

    def ask(self, now: int) -> tuple[bool, int, int]:
        """Decide one request: ``(allowed, remaining, wait in ms)``. A refused request leaves no trace."""
        while self.accepted and self.accepted[0] <= now - self.window_ms:
            self.accepted.popleft()
        if len(self.accepted) >= self.limit:
            return False, 0, self.accepted[0] + self.window_ms - now
        self.accepted.append(now)
        return True, self.limit - len(self.accepted), 0


def rate_limit(requests: DataFrame, limit: int = 20, window_ms: int = HOUR_MS) -> DataFrame:
    """Sliding-log limiter over ``(client, event_id, ts_ms)``: a decision for every request.

    Acceptance depends on earlier acceptances, so it cannot be a plain window. But where the two time
    buckets before a moment hold at most ``limit`` requests, all requests of the last one were accepted:
    the state there is known, and the history can be cut. A busy client is thus split into many chains.
    Chains that can refuse nothing are counted with a bounded window; only overloaded chains are walked in
    order, one row at a time with at most ``limit`` remembered entries, never collected.
    """
    rows = requests.withColumn("b", F.floor(F.col("ts_ms") / window_ms))
    loads = rows.groupBy("client", "b").agg(F.count("*").alias("n"))
    w = Window.partitionBy("client").orderBy("b")
    before1 = F.coalesce(F.sum("n").over(w.rangeBetween(-1, -1)), F.lit(0))
    before2 = F.coalesce(F.sum("n").over(w.rangeBetween(-2, -1)), F.lit(0))
    cut = loads.withColumn("start", before2 <= limit).withColumn("calm", (before2 <= limit) & (before1 + F.col("n") <= limit))
    chain = F.max(F.when(F.col("start"), F.col("b"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    follows = (F.lead("b").over(w) == F.col("b") + 1) & F.lead("start").over(w)
    plan = cut.select(
        "client", "b", F.struct(chain.alias("chain"), F.col("calm").alias("calm"), F.lit(False).alias("warm")).alias("own"),
        F.when(follows, F.struct((F.col("b") + 1).alias("chain"), F.lead("calm").over(w).alias("calm"), F.lit(True).alias("warm")))
        .alias("next"))
    placed = rows.join(plan, ["client", "b"]).select(
        "client", "event_id", "ts_ms", F.explode(F.array_compact(F.array("own", "next"))).alias("c")).select(
        "client", "event_id", "ts_ms", "c.*")

    group = ["client", "chain"]
    recent = Window.partitionBy(*group).orderBy("ts_ms").rangeBetween(-(window_ms - 1), 0)
    same = Window.partitionBy(*group, "ts_ms")
    later = F.count("*").over(same) - F.row_number().over(same.orderBy("event_id"))
    counted = placed.where("calm").withColumn("held", F.count("*").over(recent) - later).where("NOT warm").select(
        "client", "event_id", F.lit(True).alias("allowed"), (F.lit(limit) - F.col("held")).cast("int").alias("remaining"),
        F.lit(0).cast("long").alias("reset_ms"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in frames:
            out = []
            for client, chain_id, ts, event_id, warm in zip(pdf["client"], pdf["chain"], pdf["ts_ms"], pdf["event_id"], pdf["warm"]):
                if (client, chain_id) != current:
                    current, state = (client, chain_id), SlidingLog(limit, window_ms)
                decision = state.ask(int(ts))
                if not warm:
                    out.append((client, event_id, *decision))
            yield pd.DataFrame(out, columns=["client", "event_id", "allowed", "remaining", "reset_ms"])

    overloaded = (
        placed.where("NOT calm").repartition(*group).sortWithinPartitions(*group, "ts_ms", "event_id")
        .select("client", "chain", "ts_ms", "event_id", "warm").mapInPandas(walk, DECISION_SCHEMA))
    return counted.unionByName(overloaded)


def rate_window_count(requests: DataFrame, window_ms: int = HOUR_MS) -> DataFrame:
    """Requests of the same client within the window up to each request.

    Every request is also given to the next time bucket as context, so a busy client is counted bucket
    by bucket in parallel.
    """
    b = F.floor(F.col("ts_ms") / window_ms)
    spread = requests.select("client", "event_id", "ts_ms", F.explode(F.array(
        F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own")))).alias("p"))
    w = Window.partitionBy("client", "p.b").orderBy("ts_ms").rangeBetween(-(window_ms - 1), 0)
    counted = spread.withColumn("en_ventana", F.count("*").over(w))
    return counted.where("p.own").select("client", "event_id", "en_ventana")


def client_key(forwarded: Column, alternative: Column) -> Column:
    """First address of a forwarding list, else the other header, else ``unknown``."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(alternative, F.lit("")), F.lit("unknown"))


def snapshot_change(current: DataFrame, state: DataFrame, threshold: int = CHANGE_THRESHOLD) -> DataFrame:
    """Sizes ``(key, size)`` against the stored ones: error, baseline, changed or unchanged, and the new state."""
    both = current.select("key", F.col("size").alias("actual"), F.lit(True).alias("checked")).join(
        state.select("key", F.col("size").alias("previo")), "key", "full_outer")
    delta = F.abs(F.col("actual") - F.col("previo"))
    status = (
        F.when(F.col("checked").isNull(), "not_checked").when(F.col("actual").isNull(), "error")
        .when(F.col("previo").isNull(), "baseline").when(delta > threshold, "changed").otherwise("unchanged"))
    return both.select("key", status.alias("estado"), "previo", "actual", delta.alias("delta"),
                       F.coalesce("actual", "previo").alias("nuevo"))


def change_alerts(changes: DataFrame) -> DataFrame:
    line = F.concat(F.lit("[ALERTA] "), "key", F.lit(": "), F.col("previo").cast("string"), F.lit(" → "),
                    F.col("actual").cast("string"), F.lit(" (Δ"), F.col("delta").cast("string"), F.lit(")"))
    return changes.where("estado = 'changed'").select("key", line.alias("alerta"))


def version_change(current: DataFrame, state: DataFrame) -> DataFrame:
    """Version dates ``(key, version)`` that differ from the stored one; a first sight is no change."""
    both = current.join(state.select("key", F.col("version").alias("previa")), "key", "left")
    return both.select("key", "previa", "version", F.coalesce(F.col("version") != F.col("previa"), F.lit(False)).alias("cambio"))


def hash_change_detect(
    docs: DataFrame, state: DataFrame, force: bool = False, only: list[str] | None = None
) -> DataFrame:
    """Documents ``(key, text)`` to process: new, changed, or all when forced; ``only`` limits the keys."""
    wanted = docs.where(F.col("key").isin(*only)) if only is not None else docs
    hashed = wanted.withColumn("hash", F.sha2("text", 256)).join(
        state.select("key", F.col("hash").alias("previo")), "key", "left")
    status = F.when(F.col("previo").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("previo")), "same").otherwise("changed")
    marked = hashed.withColumn("estado", status)
    return marked if force else marked.where("estado <> 'same'")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key. A single aggregate, partial in every task, so a hot key is no problem."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def state_upsert(state: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State with the updates applied, the latest row of each key winning."""
    return latest_per_key(state.unionByName(updates), keys, order)
