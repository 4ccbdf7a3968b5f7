"""Streaming jobs run to the end of the given tables; the results must equal the batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics
from ..operators.stateful import CHANGE_THRESHOLD
from ..session import materialise, scratch_path
from ..sources.upserts import subscription_latest
from ..streaming import jobs
from ..streaming.answer_cache import AnswerCache
from ..streaming.late import LateGate
from . import derived as d
from . import stores
from .analytics import LOG, log
from .conversation import message_events
from .registry import SQL, query
from .stateful import DAY_MS, LIMIT_SQL
from .vectors import EPOCH_MS, MODES


SLICES = 4


class Feed:
    """A table that arrives in slices, as a growing log does: a slice is written by as many tasks as its rows need, the stream
    runs until it has read it, and is started again from its checkpoint when the next slice is there.

    With ``order`` the slices follow each other in time, so no row is late; ``deal`` gives each row the number of its slice;
    without either, rows arrive in any order. An empty table arrives as one slice without rows. ``batches`` counts the
    micro-batches that had rows.
    """

    def __init__(self, spark: SparkSession, table: DataFrame, label: str, order: str | None = None, deal: Column | None = None):
        self.spark, self.table, self.path, self.batches = spark, table, scratch_path(spark, f"feed-{label}"), 0
        if order is not None:
            low, high = table.agg(F.min(order), F.max(order)).first()
            edges = [] if low is None else [low + (high - low) * i / SLICES for i in range(1, SLICES)]
            deal = sum((F.when(F.col(order) >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
        self.deal = deal if deal is not None else F.pmod(F.xxhash64(*table.columns), F.lit(SLICES))

    def stream(self) -> DataFrame:
        self.spark.createDataFrame([], self.table.schema).write.mode("append").parquet(self.path)
        return self.spark.readStream.schema(self.table.schema).parquet(self.path)

    def run(self, writer) -> None:
        """Start a stream writer once a slice, until all rows are read."""
        for i in range(SLICES):
            self.table.where(self.deal == i).write.mode("append").parquet(self.path)
            running = writer.trigger(availableNow=True).start()
            running.awaitTermination()
            self.batches += sum(p["numInputRows"] > 0 for p in running.recentProgress)

    def run_into_table(self, frame: DataFrame, label: str, mode: str = "append") -> DataFrame:
        """Run a stream into a table in the shared folder."""
        out = scratch_path(self.spark, label)
        self.run(frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-progress").option("path", out))
        return jobs.read_or_empty(self.spark, out, frame.schema)

    def run_each(self, frame: DataFrame, step, label: str, mode: str = "append") -> None:
        """Run a stream through a ``foreachBatch`` step."""
        progress = scratch_path(self.spark, f"{label}-progress")
        self.run(frame.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", progress))


@query("rate_limit_stream", LIMIT_SQL)
def rate_limit_stream(t):
    feed = Feed(t.spark, t.events, "events", order="ts")
    asked = feed.stream().select(F.col("user_id").cast("string").alias("client"), "event_id", jobs.utc_timestamp("ts").alias("ts"))
    return feed.run_into_table(jobs.rate_limit_stream(asked, 5, DAY_MS), "rate-limit")


@query("subscription_latest_stream", SQL["subscription_latest"])
def subscription_latest_stream(t):
    feed = Feed(t.spark, t.orders, "orders")

    class Arriving:
        spark, sf_dir, orders = t.spark, t.sf_dir, feed.stream()

    schema = "event_id long, at timestamp_ntz, user_id long, type string, status string, sub_id string, period_end string"
    table = jobs.KeyedTable(scratch_path(t.spark, "subscriptions"), schema, ["user_id"], ["at", "event_id"])
    events = stores.subscription_events(Arriving).select("event_id", "at", "user_id", "type", "status", "sub_id", "period_end")
    feed.run_each(events, jobs.upsert_into(table, lambda df: df.where("user_id IS NOT NULL")), "subscriptions")
    return subscription_latest(table.read(t.spark))


@query("queries_per_day_stream", d.with_("", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dia, count(*) AS n FROM events GROUP BY 1"""))
def queries_per_day_stream(t):
    feed = Feed(t.spark, t.events, "events", order="ts")
    asked = feed.stream().select(jobs.utc_timestamp("ts").alias("created_at"))
    table = jobs.KeyedTable(scratch_path(t.spark, "per-day"), "dia string, n long", ["dia"], ["n"])
    feed.run_each(jobs.daily_counts(asked), jobs.upsert_into(table), "per-day", mode="update")
    return table.read(t.spark)


@query("fold_messages_stream", SQL["fold_message_events"])
def fold_messages_stream(t):
    """Answers from their events, which arrive over several micro-batches: pieces by their number, the end last."""
    events = message_events(t).withColumn("ts", F.timestamp_millis(F.lit(EPOCH_MS) + F.col("seq")))
    ends = F.col("type").isin("done", "error")
    feed = Feed(t.spark, events, "messages", deal=F.when(ends, SLICES - 1).otherwise((F.col("seq") % (SLICES - 1)).cast("int")))
    with jobs.keyed_state_store(t.spark):
        return feed.run_into_table(jobs.fold_messages_stream(feed.stream()), "messages")


@query("size_alerts_stream", """
WITH seen AS (
  SELECT page_id, v, CAST(length(html) + v * (page_id % 5) * 300 AS INTEGER) AS size, v < 1 OR page_id % 7 <> v AS ok
  FROM pages CROSS JOIN (SELECT unnest(range(4)) AS v)),
steps AS (
  SELECT CAST(page_id AS VARCHAR) AS key, v, CASE WHEN ok THEN size END AS actual,
    last_value(CASE WHEN ok THEN size END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previo
  FROM seen)
SELECT key, CAST(v AS INTEGER) AS visita, CASE WHEN actual IS NULL THEN 'error' WHEN previo IS NULL THEN 'baseline'
  WHEN abs(actual - previo) > 500 THEN 'changed' ELSE 'unchanged' END AS estado, previo, actual, abs(actual - previo) AS delta
FROM steps""")
def size_alerts_stream(t):
    """Every page is visited once a micro-batch; its size is compared with the last one known."""
    page, visit = F.col("page_id"), F.col("at")
    visits = t.pages.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).select(
        page.cast("string").alias("key"), "at",
        F.when((visit < 1) | (page % 7 != visit), F.length("html") + visit * (page % 5) * 300).cast("int").alias("size"))
    feed, folder = Feed(t.spark, visits, "visits", deal=visit), scratch_path(t.spark, "sizes")
    table = jobs.KeyedTable(folder, "key string, size int, at int", ["key"], ["at"])
    feed.run_each(feed.stream(), jobs.track_sizes(table, f"{folder}-alerts", CHANGE_THRESHOLD), "sizes")
    schema = "key string, estado string, previo int, actual int, delta int, nuevo int, at int, batch long"
    return jobs.read_or_empty(t.spark, f"{folder}-alerts", schema).select("key", F.col("at").alias("visita"), "estado", "previo", "actual", "delta")


LATE_MS = 5 * DAY_MS


@query("late_rows_stream", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dia, count(*) FILTER (NOT late) AS aceptadas, count(*) FILTER (late) AS tardias FROM (
  SELECT ts, coalesce(epoch_ms(ts) < {-LATE_MS} + (SELECT max(epoch_ms(b.ts)) FROM events b WHERE b.event_id % {SLICES} < e.event_id % {SLICES}), false) AS late
  FROM events e) GROUP BY 1""")
def late_rows_stream(t):
    """Accepted and late events per day; the events arrive out of order, dealt over the slices by their ids."""
    events = t.events.select("event_id", jobs.utc_timestamp("ts").alias("ts"))
    feed = Feed(t.spark, events, "events", deal=F.col("event_id") % SLICES)
    gate = LateGate(scratch_path(t.spark, "late"), "event_id long, ts timestamp", F.col("ts"), LATE_MS)
    feed.run_each(feed.stream(), gate, "late")
    kinds = gate.accepted(t.spark).withColumn("late", F.lit(False)).unionByName(gate.late(t.spark).withColumn("late", F.lit(True)))
    day = F.date_format(F.from_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd")
    return kinds.groupBy(day.alias("dia")).agg(F.count_if(~F.col("late")).alias("aceptadas"), F.count_if("late").alias("tardias"))


CACHE_SIMILARITY = 0.3


@query("answer_cache_stream", f"""
WITH RECURSIVE asked AS (
  SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS n, {d.sql_pick(MODES, 'vec_id')} AS mode, CAST(embedding AS DOUBLE[]) AS v,
    {EPOCH_MS} + vec_id * 3600000 AS ms, length(text) > 100 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS fit
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
near AS (
  SELECT a.n, b.id AS stored, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM asked a JOIN asked b
  ON a.mode = b.mode AND b.ms < a.ms AND a.ms - b.ms < 168 * 3600000 AND b.fit WHERE round(list_cosine_similarity(a.v, b.v), 6) >= {CACHE_SIMILARITY}),
before AS (SELECT n, list(stored) AS ids FROM near GROUP BY n),
walk(n, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT a.n, CASE WHEN a.fit AND NOT list_has_any(w.kept, coalesce(b.ids, [])) THEN list_append(w.kept, a.id) ELSE w.kept END
  FROM walk w JOIN asked a ON a.n = w.n + 1 LEFT JOIN before b ON b.n = a.n),
entries AS (SELECT unnest(kept) AS id FROM walk WHERE n = (SELECT max(n) FROM walk))
SELECT a.id AS query_id, CASE WHEN h.stored IS NOT NULL THEN 'hit' WHEN e.id IS NOT NULL THEN 'stored' ELSE 'miss' END AS outcome,
  h.stored AS cache_id, h.similarity
FROM asked a LEFT JOIN entries e ON e.id = a.id LEFT JOIN (
  SELECT n, stored, similarity FROM near WHERE stored IN (SELECT id FROM entries)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY similarity DESC, stored) = 1) h ON h.n = a.n""")
def answer_cache_stream(t):
    """Every vector is a question, an hour after the one before; the document of its number is the answer."""
    i = F.col("vec_id")
    asked = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("answer")), "vec_id", "left").select(
        i.cast("long").alias("query_id"), d.pick(MODES, i).alias("mode"), F.col("embedding").cast("array<double>").alias("query_vector"),
        (F.lit(EPOCH_MS) + i * 3_600_000).cast("long").alias("query_ms"), F.substring("answer", 1, 80).alias("query_text"), "answer",
        (i % 5 != 0).alias("single_turn"), (i % 7 == 0).alias("rule_active"))
    feed = Feed(t.spark, materialise(asked, "asked-rows"), "asked", order="query_ms")  # joined once, not for each slice
    cache = AnswerCache(scratch_path(t.spark, "answers"), CACHE_SIMILARITY)
    feed.run_each(feed.stream(), cache, "answers")
    return cache.outcomes(t.spark).drop("query_ms")


RANKS = [0.5, 0.9, 0.99]
RANK_ERROR = 0.01


@query("latency_sketch_stream", d.with_("", f"""
SELECT modo, count(*) AS n, r.cuantil, true AS dentro FROM log CROSS JOIN (SELECT unnest([{', '.join(map(str, RANKS))}]::DOUBLE[]) AS cuantil) r
WHERE latencia_ms > 0 GROUP BY modo, r.cuantil""", LOG))
def latency_sketch_stream(t):
    """Quantiles per mode from sketches that every micro-batch adds to; each must lie within the stated rank error of the exact one."""
    rows = log(t).select("modo", "latencia_ms", "created_at")
    feed, table = Feed(t.spark, rows, "latencies", order="created_at"), jobs.SketchTable(scratch_path(t.spark, "sketches"))
    feed.run_each(feed.stream(), table, "latencies")
    found = analytics.sketch_quantiles(table.merged(t.spark, ["modo"]), RANKS)
    return analytics.rank_error(rows, found, "modo").select("modo", "n", "cuantil", (F.col("desvio") <= RANK_ERROR).alias("dentro"))
