"""Streams that keep state: late rows, the answer cache, answers folded from events, feeds of any size."""

import math
import random
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probatum.catalog.streams import Feed
from probatum.operators import analytics, near_in_time
from probatum.streaming import jobs
from probatum.streaming.answer_cache import DAY_MS, HOUR_MS, AnswerCache
from probatum.streaming.late import LateGate

START = 1_700_000_000_000


def timed(spark, rows):
    return spark.createDataFrame(rows, "id long, ms long").select("id", F.timestamp_millis("ms").alias("ts"))


def gate_of(tmp_path):
    return LateGate(str(tmp_path / "gate"), "id long, ts timestamp", F.col("ts"), 1000)


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    gate = gate_of(tmp_path)
    gate(timed(spark, [(1, START), (2, START + 5000), (3, None)]), 0)
    second = timed(spark, [(4, START + 3999), (5, START + 4000), (6, START + 9000), (7, None)])
    for _ in range(2):  # the same micro-batch again
        gate(second, 1)
    gate(timed(spark, []), 2)
    gate(timed(spark, [(8, START + 7999), (9, START + 8000)]), 3)
    assert sorted(r.id for r in gate.accepted(spark).collect()) == [1, 2, 5, 6, 9]
    assert sorted(r.id for r in gate.late(spark).collect()) == [3, 4, 7, 8]
    assert {(r.batch, r.accepted, r.late) for r in gate.marks(spark).collect()} == {(0, 2, 1), (1, 2, 2), (2, 0, 0), (3, 1, 1)}


def test_a_batch_without_its_mark_is_not_read(spark, tmp_path):
    gate = gate_of(tmp_path)
    gate(timed(spark, [(1, START)]), 0)
    gate(timed(spark, [(2, START + 1)]), 1)
    shutil.rmtree(tmp_path / "gate" / "marks" / "batch=1")  # as if the run had ended between its two writes
    assert [r.id for r in gate.accepted(spark).collect()] == [1]
    gate(timed(spark, [(2, START + 1)]), 1)
    assert sorted(r.id for r in gate.accepted(spark).collect()) == [1, 2]


def test_nothing_has_arrived_yet(spark, tmp_path):
    gate = gate_of(tmp_path)
    assert gate.accepted(spark).count() == gate.late(spark).count() == gate.marks(spark).count() == 0


QUESTION = ("query_id long, mode string, query_vector array<double>, query_ms long, query_text string, answer string, "
            "single_turn boolean, rule_active boolean")


def questions():
    """Questions around few centres, with copies, equal times, a gap longer than the age, and unusable rows."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    out = []
    for i in range(120):
        vector = [float("%.3f" % (x + rng.gauss(0, 0.25))) for x in rng.choice(centres)]
        if i % 9 == 4:
            vector = out[-1][2]
        moment = START + (i - i % 2 * (i % 3 == 0)) * 10 * HOUR_MS
        out.append([i, "ab"[rng.random() < 0.3], vector, moment, f"q{i}", "x" * (150 if rng.random() < 0.8 else 5), rng.random() < 0.9, rng.random() < 0.1])
    out[50][1] = None
    out[60][2] = None
    return [tuple(r) for r in out]


def replay(rows, least, age_ms):
    """Question by question."""
    stored, out = [], {}
    for qid, mode, v, ms, _, answer, single, ruled in sorted(rows, key=lambda r: (r[3], r[0])):
        best = None
        for sid, smode, sv, sms in stored:
            if v is None or mode is None or smode != mode or not 0 < ms - sms < age_ms:
                continue
            sim = round(sum(a * b for a, b in zip(v, sv)) / math.hypot(*v) / math.hypot(*sv), 6)
            if sim >= least and (best is None or (-sim, sid) < (-best[1], best[0])):
                best = (sid, sim)
        fit = len(answer) > 100 and single and not ruled and v is not None and mode is not None
        if best is None and fit:
            stored.append((qid, mode, v, ms))
        out[qid] = ("hit", best[0]) if best else ("stored" if fit else "miss", None)
    return out


@pytest.mark.parametrize("cuts", [[0, 120], [0, 31, 64, 90, 120]])
def test_answer_cache_equals_a_replay_in_order(spark, tmp_path, cuts):
    rows = questions()
    want = replay(rows, 0.95, 168 * HOUR_MS)
    assert {kind for kind, _ in want.values()} == {"hit", "stored", "miss"}
    cache = AnswerCache(str(tmp_path / "cache"), 0.95)
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(1 + (n == 0)):  # the first micro-batch is repeated
            cache(spark.createDataFrame(rows[lo:hi], QUESTION), n)
    cache(spark.createDataFrame([], QUESTION), len(cuts))
    assert {r.query_id: (r.outcome, r.cache_id) for r in cache.outcomes(spark).collect()} == want
    hits = {r.cache_id: r.hits for r in cache.with_hits(spark).collect()}
    assert hits == {q: sum(w == ("hit", q) for w in want.values()) for q, w in want.items() if w[0] == "stored"}


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_answer_cache_equals_a_replay_with_small_blocks(spark, tmp_path, block_rows):
    rows = questions()
    cache = AnswerCache(str(tmp_path / "cache"), 0.95, block_rows=block_rows)
    for n, (lo, hi) in enumerate(((0, 40), (40, len(rows)))):
        cache(spark.createDataFrame(rows[lo:hi], QUESTION), n)
    assert {r.query_id: (r.outcome, r.cache_id) for r in cache.outcomes(spark).collect()} == replay(rows, 0.95, 168 * HOUR_MS)


def test_a_chain_of_questions_is_settled_in_few_rounds(spark, tmp_path, monkeypatch):
    turn = [i * 0.3 for i in range(60)]  # each is similar to the one before and to no other
    rows = [(i, "a", [math.cos(x), math.sin(x)], START + i * 13 * HOUR_MS, "q", "x" * 150, True, False) for i, x in enumerate(turn)]
    scans, real = [], AnswerCache._best
    monkeypatch.setattr(AnswerCache, "_best", lambda *a, **b: scans.append(1) or real(*a, **b))
    cache = AnswerCache(str(tmp_path / "cache"), 0.95)
    cache(spark.createDataFrame(rows, QUESTION), 0)
    assert len(scans) <= 8  # two a round; a round for each of the 30 stored would make 60
    assert {r.query_id: (r.outcome, r.cache_id) for r in cache.outcomes(spark).collect()} == replay(rows, 0.95, 168 * HOUR_MS)


def test_a_question_meets_only_answers_of_its_time(spark):
    n, window = 3000, 168 * HOUR_MS
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.lit("a").alias("mode"), F.array(F.lit(1.0), F.rand(1)).alias("query_vector"),
                                  (F.lit(START) + F.col("id") * 24 * HOUR_MS).alias("query_ms"))
    stored = asked.select(F.col("query_id").alias("cache_id"), "mode", F.col("query_vector").cast("array<float>").alias("embedding"), F.col("query_ms").alias("created_ms"))
    found = near_in_time.best_earlier(stored, asked, window, 0.9, block_rows=50)
    got = {r.query_id: (r.cache_id, r.similarity) for r in found.collect()}
    unit = np.array([r.query_vector for r in asked.orderBy("query_id").collect()])
    kept = unit.astype(np.float32).astype(np.float64)
    unit, kept = (x / np.linalg.norm(x, axis=1)[:, None] for x in (unit, kept))
    want = {}
    for i in range(n):
        near = np.round(kept[max(i - 6, 0):i] @ unit[i], 6)
        if len(near) and near.max() >= 0.9:
            want[i] = (max(i - 6, 0) + int(near.argmax()), near.max())
    assert got.keys() == want.keys() and all(got[i][1] == pytest.approx(want[i][1], abs=2e-6) for i in want)
    assert sum(got[i][0] != want[i][0] for i in want) <= 3  # other than where rounding differs


def test_old_answers_are_deleted_by_day(spark, tmp_path):
    cache = AnswerCache(str(tmp_path / "cache"), 0.95)
    assert cache.evict(spark, START) == 0
    rows = [(i, "a", [1.0, float(i)], START + i * 20 * DAY_MS, "q", "x" * 150, True, False) for i in range(3)]
    cache(spark.createDataFrame(rows, QUESTION), 0)
    assert cache.entries(spark).count() == 3
    assert cache.evict(spark, START + 30 * DAY_MS) == 2
    assert [r.cache_id for r in cache.entries(spark).collect()] == [2]


EVENT = "msg_id long, seq long, type string, payload string, ms long"


def fold(spark, tmp_path, slices):
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for i, rows in enumerate(slices):
        frame = spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        frame.coalesce(1).write.mode("append").parquet(path)
        stream = jobs.fold_messages_stream(spark.readStream.schema(frame.schema).parquet(path), "1 second", 5000)
        with jobs.keyed_state_store(spark):
            running = stream.writeStream.option("checkpointLocation", str(tmp_path / "progress")).option("path", out).trigger(availableNow=True).start()
            running.awaitTermination()
    state = [op["numRowsTotal"] for p in running.recentProgress for op in p["stateOperators"]]
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()), state


def test_answers_over_restarts_idle_ones_and_redelivered_pieces(spark, tmp_path):
    got, state = fold(spark, tmp_path, [
        [(1, 10, "chunk", "uno ", START), (1, 1, "fuentes", "3", START), (2, 10, "chunk", "solo ", START), (3, 1, "meta", "m", START)],
        [(1, 10, "chunk", "uno ", START + 1000), (1, 11, "chunk", "dos", START + 1000), (1, 2, "fuentes", "4", START + 1000),
         (3, 9, "error", "fin", START + 1000)],
        [(1, 99, "done", None, START + 2000)],
        [(9, 1, "done", None, START + 60_000)],
    ])
    assert got == [(1, "uno dos", 4, None, None, True), (2, "solo ", None, None, None, False), (3, "", None, "m", "fin", False),
                   (9, "", None, None, None, True)]
    assert state[-1] == 0  # nothing is kept of ended answers


class CountedState:
    """State of one key in memory; counts the calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattribute__(self, name):
        if name in ("calls", "held"):
            return object.__getattribute__(self, name)
        self.calls.append(name)
        return object.__getattribute__(self, name)

    def exists(self):
        return self.held is not None

    def get(self):
        return iter(self.held or []) if isinstance(self.held, list) else self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None

    def appendList(self, values):
        self.held = (self.held or []) + values

    def containsKey(self, key):
        return key in (self.held or {})

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held = (self.held or {}) | {key: value}

    def iterator(self):
        return iter((self.held or {}).items())


class CountedHandle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def state(self, *_):
        return CountedState(self.calls)

    getListState = getMapState = getValueState = state

    def registerTimer(self, ms):
        self.calls.append("registerTimer")
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls.append("deleteTimer")
        self.timers.remove(ms)


def test_an_answer_asks_little_of_its_state():
    class Now:
        at = 0

        def getCurrentWatermarkInMs(self):
            return self.at

    def rows(n, *extra):
        events = [(10 + 4 * i + n, "chunk", f"{n}{i} ") for i in range(4)] + list(extra)
        return iter([pd.DataFrame([(s, k, p, 1000 * n) for s, k, p in events], columns=["seq", "type", "payload", "ts_ms"])])

    fold, handle, now, out = jobs.MessageFold(5000), CountedHandle(), Now(), []
    fold.init(handle)
    for n, extra in enumerate([[(3, "meta", "m")], [(1, "fuentes", "2")], [(2, "fuentes", "4")], [(99, "done", "fin")]]):
        out += fold.handleInputRows((7,), rows(n, *extra), now)
    assert [tuple(r) for f in out for r in f.itertuples(index=False)] == [(7, "".join(f"{n}{i} " for i in range(4) for n in range(4)), 4, "m", None, True)]
    assert not handle.timers and len(handle.calls) <= 16

    fold.init(handle)
    list(fold.handleInputRows((8,), rows(0), now))
    list(fold.handleInputRows((8,), rows(2), now))
    now.at = 5000  # the first timer fires, but rows have come since
    handle.timers.discard(5000)
    assert list(fold.handleExpiredTimer((8,), now, None)) == [] and handle.timers == {7000}
    now.at = 7000
    assert len(list(fold.handleExpiredTimer((8,), now, None))) == 1


def test_feed_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, ts timestamp_ntz")
    feed = Feed(spark, empty, "empty", order="ts")
    assert feed.run_into_table(feed.stream(), "empty-out").count() == 0
    assert feed.batches == 0


def test_feed_arrives_in_slices_of_time(spark):
    table = spark.range(40).select("id", F.timestamp_millis(F.lit(START) + F.col("id") * 1000).alias("ts"))
    feed, seen = Feed(spark, table, "slices", order="ts"), []
    feed.run_each(feed.stream(), lambda batch, n: seen.append(sorted(r.id for r in batch.collect())), "slices")
    assert [ids for ids in seen if ids] == [list(range(lo, lo + 10)) for lo in range(0, 40, 10)]
    assert feed.batches == 4


def latencies(spark, n, start=0):
    i = F.col("id")
    return spark.range(start, start + n).select(
        F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").alias("modo"), F.when(i % 10 != 9, F.pmod(F.xxhash64("id"), F.lit(5000)).cast("int")).alias("latencia_ms"),
        F.timestamp_millis(F.lit(START) + i * 10_000).alias("created_at"))


def test_merged_sketches_are_within_the_stated_error(spark, tmp_path):
    table = jobs.SketchTable(str(tmp_path / "sketches"))
    assert table.merged(spark, ["modo"]).count() == 0
    for n in range(6):
        for _ in range(1 + (n == 2)):  # one micro-batch again
            table(latencies(spark, 10_000, n * 10_000), n)
    rows = latencies(spark, 60_000)
    exact = {r.modo: r.n for r in rows.where("latencia_ms > 0").groupBy("modo").agg(F.count("*").alias("n")).collect()}
    for source in (table, table.compact(spark, str(tmp_path / "base"))):
        found = analytics.rank_error(rows, analytics.sketch_quantiles(source.merged(spark, ["modo"]), [0.0, 0.5, 0.9, 0.99, 1.0]), "modo").collect()
        assert len(found) == 15 and {r.modo: r.n for r in found} == exact  # the mode that is null too
        assert max(r.desvio for r in found) <= 0.01
    days = table.merged(spark, ["dia"])
    assert days.count() == rows.select(F.to_date("created_at")).distinct().count()


def test_small_sketches_are_exact_and_ties_span_ranks(spark):
    rows = spark.createDataFrame([("a", v, 0) for v in [0, 5, 5, 5, 9, None]], "modo string, latencia_ms int, ms long").select(
        "modo", "latencia_ms", F.timestamp_millis("ms").alias("created_at"))
    found = analytics.sketch_quantiles(analytics.latency_sketches(rows).drop("dia"), [0.5, 1.0])
    assert [(r.n, r.cuantil, r.latencia_ms, r.desvio) for r in analytics.rank_error(rows, found, "modo").orderBy("cuantil").collect()] == [
        (4, 0.5, 5, 0.0), (4, 1.0, 9, 0.0)]
    far = found.withColumn("latencia_ms", F.lit(9).cast("long"))
    assert analytics.rank_error(rows, far, "modo").where("cuantil = 0.5").first().desvio == 0.25
