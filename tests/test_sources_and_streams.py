"""Readers on files as they occur, and streams against their batch forms."""

import json

from pyspark.sql import functions as F

from probatum.operators import conversation, stateful
from probatum.plans import ingest as ingesting
from probatum.sources import readers
from probatum.streaming import jobs


def test_text_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_text("uno\ndos", encoding="utf-8")
    (tmp_path / "a" / "y.pdf").write_text("no")
    got = readers.scan_documents(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in got] == [("x.txt", "uno\ndos")]


def test_table_of_one_file_or_a_folder_of_files_has_one_name(spark, tmp_path):
    """A table written by Spark is a folder; its documents are named after the table, not after its part files."""
    from __spark_entry__ import queries

    spark.createDataFrame([(i, "t", "es") for i in range(4)], "doc_id long, text string, lang string").repartition(2).write.parquet(
        str(tmp_path / "documents.parquet"))
    assert {r.archivo for r in queries()["scan_documents"](spark, str(tmp_path)).collect()} == {"documents.parquet"}
    assert {r.archivo for r in queries()["scan_documents"](spark, "/root/testdata/sf0.001").collect()} == {"documents.parquet"}


def test_metadata_folder(spark, tmp_path):
    good = tmp_path / "01_Leyes" / "ley" / "03_metadatos"
    good.mkdir(parents=True)
    (good / "metadata.json").write_text(json.dumps({"titulo_oficial": "T", "tipo_norma": "Ley", "numero": "7", "anio": "1999"}))
    other = tmp_path / "varios"
    other.mkdir()
    (other / "metadata.json").write_text("{}")
    got = readers.scan_metadata(spark, str(tmp_path)).collect()
    assert [(r.titulo_oficial, r.numero) for r in got] == [("T", "7")]


def test_inventory_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_bytes("﻿ddu_numero,materia,tamano_pdf\n541,\"Uno, dos\ny \"\"tres\"\"\",4853Kb\n".encode())
    got = readers.scan_inventory(spark, str(path), "official_index").collect()
    assert [tuple(r) for r in got] == [("541", 'Uno, dos\ny "tres"', "4853Kb")]


def test_manifest_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"DDU-1": {"tipo": "DDU", "numero": "1", "chars": 9}}))
    assert [(r.key, r.tipo, r.chars) for r in readers.scan_manifest(spark, str(tmp_path / "m.json")).collect()] == [("DDU-1", "DDU", 9)]
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.scan_manifest(spark, str(tmp_path / "bad.json")).count() == 0


def run(stream, spark, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(
        availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q


def feed(spark, tmp_path, frames, schema):
    """Frames as the files of a stream, one micro-batch each."""
    path = tmp_path / "feed"
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_rate_limit_stream_over_several_batches(spark, tmp_path):
    data = [("c%d" % (i % 3), i, 1_700_000_000_000 + i * 400) for i in range(240)]
    df = spark.createDataFrame(data, "client string, event_id long, ts_ms long")
    timed = df.select("client", "event_id", F.timestamp_millis("ts_ms").alias("ts"))
    frames = [timed.where(F.col("event_id").between(lo, lo + 59)) for lo in range(0, 240, 60)]
    got, _ = run(jobs.rate_limit_stream(feed(spark, tmp_path, frames, timed.schema), 5, 20_000), spark, tmp_path)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in stateful.rate_limit(df, 5, 20_000).collect()}


def test_messages_stream(spark, tmp_path):
    data = []
    for m in range(4):
        kinds = [("fuentes", str(m))] + [("chunk", f"w{i} ") for i in range(6)] + [("meta", f"m{m}"), ("error" if m == 2 else "done", "fin")]
        data += [(m, s, k, p) for s, (k, p) in enumerate(kinds)]
    df = spark.createDataFrame(data, "msg_id long, seq long, type string, payload string")
    timed = df.withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("seq") * 100))
    frames = [timed.where("seq < 4"), timed.where("seq >= 4")]
    with jobs.keyed_state_store(spark):
        got, _ = run(jobs.fold_messages_stream(feed(spark, tmp_path, frames, timed.schema)), spark, tmp_path)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in conversation.fold_message_events(df).collect()}


def test_replays_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(i % 10, 1_700_000_000_000 + i) for i in range(30)], "event_id long, ms long").select(
        "event_id", F.timestamp_millis("ms").alias("at"))
    got, _ = run(jobs.without_replays(feed(spark, tmp_path, [df], df.schema)), spark, tmp_path)
    assert got.count() == 10


def test_sizes_are_tracked_over_batches(spark, tmp_path):
    table = jobs.KeyedTable(str(tmp_path / "state"), "key string, size int, at long", ["key"], ["at"])
    step = jobs.track_sizes(table, str(tmp_path / "alerts"), 500)
    schema = "key string, size int, at long"
    step(spark.createDataFrame([("a", 1000, 1), ("b", 50, 1)], schema), 0)
    step(spark.createDataFrame([("a", 1600, 2), ("b", 100, 2), ("c", None, 2)], schema), 1)
    step(spark.createDataFrame([("a", 1600, 2), ("b", 100, 2), ("c", None, 2)], schema), 1)  # the same batch again
    got = {(r.batch, r.key): r.estado for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    assert got == {(0, "a"): "baseline", (0, "b"): "baseline", (1, "a"): "changed", (1, "b"): "unchanged", (1, "c"): "error"}
    assert {r.key: r.size for r in table.read(spark).collect()} == {"a": 1600, "b": 100}
    assert {r.key: r.size for r in table.compact(spark, str(tmp_path / "base")).read(spark).collect()} == {"a": 1600, "b": 100}


def test_ingest_is_incremental_and_repeatable(spark, tmp_path):
    def docs(*texts):
        return spark.createDataFrame([(f"LEY-{i}", "LEY", str(i), "u", x) for i, x in enumerate(texts)],
                                     "key string, tipo string, numero string, url string, text string")

    article = "Artículo {}.- texto suficientemente largo para ser una sección"
    corpus = ingesting.Corpus(spark, str(tmp_path))
    first = ingesting.ingest(corpus, docs(article.format(1), article.format(2)), 1).first()
    assert (first.procesados, first.sin_cambio, first.chunks) == (2, 0, 2)
    changed = docs(article.format(1), article.format(2) + " nuevo\n" + article.format(3))
    for _ in range(2):
        again = ingesting.ingest(corpus, changed, 2).first()
        assert (again.procesados, again.sin_cambio, again.chunks) == (1, 1, 2)
    assert sorted((r.doc_key, r.orden) for r in corpus.chunks().collect()) == [("LEY-0", 0), ("LEY-1", 0), ("LEY-1", 1)]
    assert corpus.index().stats.first().chunks == 3


def test_ingest_cuts_each_type_by_its_own_layout(spark, tmp_path):
    body = "con texto suficientemente largo para que sea una sección propia del documento"
    texts = [("LGUC", f"TÍTULO I Normas\nArtículo 1.- Uno {body}\nArtículo 2.- Dos {body}", ["1", "2"]),
             ("OGUC", f"TÍTULO 2\nArtículo 2.1.1. Uno {body}\nArtículo 2.1.2. Dos {body}", ["2.1.1", "2.1.2"]),
             ("LEY", "Sin artículos. " + "Un párrafo largo. " * 10, ["p1"]),
             ("DDU", f"1. Primero\n{body}\n2. Segundo\n{body}\n3. Tercero\n{body}", ["1", "2", "3"]),
             ("CGR", f"ANTECEDENTES {body} {body}\n\nCONCLUSIÓN {body} {body}", ["9-antecedentes-1", "9-conclusión-2"])]
    docs = spark.createDataFrame([(f"{t}-9", t, "9", "u", text) for t, text, _ in texts], "key string, tipo string, numero string, url string, text string")
    corpus = ingesting.Corpus(spark, str(tmp_path))
    ingesting.ingest(corpus, docs, 1).first()
    got = {}
    for r in corpus.chunks().orderBy("doc_key", "orden").collect():
        got.setdefault(r.doc_key, []).append(r.metadatos.articulo)
    assert got == {f"{t}-9": want for t, _, want in texts}
