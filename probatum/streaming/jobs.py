"""Streaming forms of the state-carrying jobs.

Event time with a watermark (10 minutes by default): rows later than that are dropped by Spark and counted in
the query's progress, see ``late_rows``. State of a client ends when its window has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.analytics import latency_sketches, merge_sketches
from ..operators.stateful import DECISION_SCHEMA, HOUR_MS, SlidingLog, latest_per_key, snapshot_change

WATERMARK = "10 minutes"


def utc_timestamp(column: str) -> Column:
    """A time without zone read as UTC, whatever the session's zone."""
    return F.to_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())


def daily_counts(log: DataFrame, time: str = "created_at", watermark: str = WATERMARK) -> DataFrame:
    """Queries per calendar day."""
    counted = log.withWatermark(time, watermark).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").cast("string").alias("dia"), "n")


def rate_limit_stream(
    requests: DataFrame, limit: int = 20, window_ms: int = HOUR_MS, watermark: str = WATERMARK
) -> DataFrame:
    """Decision for every request ``(client, event_id, ts)`` as it arrives.

    Requests of a micro-batch are decided in time order; the state holds at most ``limit`` times per client
    and expires one window after the last request.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(limit, window_ms, list(state.get[0]) if state.exists else None)
        batch = pd.concat(frames).sort_values(["ts_ms", "event_id"])
        out = [(key[0], event_id, *log.ask(int(ts))) for ts, event_id in zip(batch["ts_ms"], batch["event_id"])]
        state.update((list(log.accepted),))
        state.setTimeoutTimestamp(max(int(batch["ts_ms"].max()), state.getCurrentWatermarkMs()) + window_ms)
        yield pd.DataFrame(out, columns=["client", "event_id", "allowed", "remaining", "reset_ms"])

    timed = requests.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", watermark)
    return timed.groupBy("client").applyInPandasWithState(
        decide, DECISION_SCHEMA, "accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def keyed_state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which their list and value state needs."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class MessageFold(StatefulProcessor):
    """Events of one answer until it ends. Pieces of text are appended to a list as they come and read once, at the end; of each
    other type the newest is kept. A timer ends an answer that has been idle; all state goes with the answer.

    Every call on state is a message to the JVM, so what is not a piece is one value, read and written once a micro-batch, and the
    timer is set once: when it fires too early, as rows have come since, it is set again.
    """

    COLUMNS = ["msg_id", "texto", "fuentes", "meta_id", "error", "cerrado"]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, payload string")
        self.rest = handle.getValueState("rest", "due long, timer long, last array<struct<type:string,seq:long,payload:string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.rest.get()
        newest, came = timerValues.getCurrentWatermarkInMs(), []
        last = {kind: (seq, payload) for kind, seq, payload in known[2]} if known else {}
        for pdf in rows:
            newest = max(newest, int(pdf["ts_ms"].max()))
            for seq, kind, payload in zip(pdf["seq"].tolist(), pdf["type"].tolist(), pdf["payload"].tolist()):
                if kind == "chunk":
                    came.append((seq, payload))
                elif kind not in last or seq >= last[kind][0]:
                    last[kind] = (seq, payload)
        if "done" in last or "error" in last:
            if known:
                self.handle.deleteTimer(known[1])
            yield self.finish(key, last, came, bool(known))
            return
        if came:
            self.pieces.appendList(came)
        due = newest + self.idle_ms
        if not known:
            self.handle.registerTimer(due)
        self.rest.update((due, known[1] if known else due, [(kind, *value) for kind, value in last.items()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, _, last = self.rest.get()
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            self.rest.update((due, due, last))
            return
        yield self.finish(key, {kind: (seq, payload) for kind, seq, payload in last}, [], True)

    def finish(self, key, last: dict, came: list, stored: bool) -> pd.DataFrame:
        pieces = {}
        if stored:
            pieces = dict(self.pieces.get())
            self.pieces.clear()
            self.rest.clear()
        pieces.update(came)
        text = "".join(pieces[seq] for seq in sorted(pieces) if pieces[seq] is not None)
        sources, meta, error = (last.get(kind, (0, None))[1] for kind in ("fuentes", "meta", "error"))
        row = (key[0], text, int(sources) if sources is not None else None, meta, error, "done" in last)
        return pd.DataFrame({name: pd.Series([value], dtype="Int32" if name == "fuentes" else None if name in ("msg_id", "cerrado") else object)
                             for name, value in zip(self.COLUMNS, row)})

    def close(self) -> None:
        pass


def fold_messages_stream(events: DataFrame, watermark: str = WATERMARK, idle_ms: int = HOUR_MS) -> DataFrame:
    """Finished answers from their events ``(msg_id, seq, type, payload, ts)``, emitted once when ``done`` or
    ``error`` arrives, or unfinished after an idle time. Start it inside ``keyed_state_store``."""
    schema = "msg_id long, texto string, fuentes int, meta_id string, error string, cerrado boolean"
    timed = events.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", watermark)
    return timed.groupBy("msg_id").transformWithStateInPandas(MessageFold(idle_ms), schema, "append", "eventTime")


def without_replays(events: DataFrame, key: str = "event_id", time: str = "at", watermark: str = WATERMARK) -> DataFrame:
    """Events without repeated deliveries."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, without rows as long as nothing has been written there."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(conf).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class KeyedTable:
    """Latest row per key, kept as appended changes.

    Each micro-batch writes its own folder, named by its number, so a repeated batch overwrites itself; a
    folder is never rewritten otherwise. ``compact`` folds the changes into one base folder.
    """

    def __init__(self, path: str, schema: str, keys: list[str], order: list[str]):
        self.path, self.schema, self.keys, self.order = path, schema, keys, order

    def append(self, rows: DataFrame, batch: int) -> None:
        latest_per_key(rows, self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def history(self, spark, before: int | None = None) -> DataFrame:
        rows = read_or_empty(spark, self.path, f"{self.schema}, batch long")
        rows = rows.where(F.col("batch") < before) if before is not None else rows
        return rows.drop("batch")

    def read(self, spark, before: int | None = None) -> DataFrame:
        """Current rows; with ``before`` as they were when that batch began."""
        return latest_per_key(self.history(spark, before), self.keys, self.order)

    def compact(self, spark, path: str) -> KeyedTable:
        """A copy with a single folder."""
        self.read(spark).write.mode("overwrite").parquet(f"{path}/batch=-1")
        return KeyedTable(path, self.schema, self.keys, self.order)


def upsert_into(table: KeyedTable, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """``foreachBatch`` function that applies a micro-batch to a keyed table."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.append(prepare(batch), batch_id)

    return apply


def track_sizes(table: KeyedTable, alerts_path: str, threshold: int):
    """``foreachBatch`` function for ``(key, size, at)``: compare with the stored sizes, write alerts, store the new."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = latest_per_key(batch.select("key", "at", "size"), ["key"], ["at"])
        stored = table.read(spark, before=batch_id).join(now.select("key"), "key", "left_semi")
        changes = snapshot_change(now, stored, threshold).join(now.select("key", "at"), "key", "left")
        changes.write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")
        table.append(now.where("size IS NOT NULL").select("key", "size", "at"), batch_id)

    return apply


class SketchTable:
    """Quantile sketches per day and mode, kept as what each micro-batch adds.

    A micro-batch writes the sketches of its own rows to its own folder, so a repeated one replaces itself; late rows of a day are
    one more sketch of that day. Readers merge; ``compact`` writes the merged sketches of all folders into one.
    """

    SCHEMA = "dia date, modo string, sketch binary"

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        latency_sketches(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def merged(self, spark: SparkSession, by: list[str]) -> DataFrame:
        return merge_sketches(read_or_empty(spark, self.path, self.SCHEMA), by)

    def compact(self, spark: SparkSession, path: str) -> SketchTable:
        self.merged(spark, ["dia", "modo"]).write.mode("overwrite").parquet(f"{path}/batch=-1")
        return SketchTable(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped so far because they came after the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0))
               for progress in query.recentProgress for op in progress.get("stateOperators", []))
