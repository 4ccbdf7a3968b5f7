"""Stages of the corpus pipeline on small tables: clashing names, nulls, repeated rows, exact times, empty tables."""

import datetime
import random
from collections import Counter

import pytest

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, mark timestamp, _mark timestamp_ntz, all double"
MOMENT = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
RNG = random.Random(4)
WORDS = [f"word{RNG.randrange(10 ** 6)}" for _ in range(3000)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def row(i, text, source="a"):
    return (i, text, "en", source, len(text) if text is not None else None, "k", MOMENT, MOMENT, 0.5)


LONG = prose(120)
TEXTS = [(3, LONG), (1, LONG + " end"), (5, LONG), (5, LONG), (7, prose(90)), (8, None), (9, ""), (None, prose(80)), (11, prose(60) + " " + LONG[:700])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([row(i, t) for i, t in TEXTS], SCHEMA).repartition(3)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_one_document_of_each_group_stays_unchanged(spark, docs):
    got = cp.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert rows(got) == Counter(row(i, t) for i, t in TEXTS if i not in (3, 5))


def test_repeats_are_cut_and_other_columns_stay_exact(spark, docs):
    got = cp.cut_repeats(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    found = got.collect()
    assert len(found) == len(TEXTS)
    assert all((r._key, r.mark, r._mark, r["all"]) == ("k", MOMENT, MOMENT, 0.5) for r in found)
    texts = {r.doc_id: r.text for r in found}
    assert texts[7] == dict(TEXTS)[7] and texts[None] == dict(TEXTS)[None]
    assert len(texts[3]) < len(LONG) and all(r.n_chars == len(r.text) for r in found if r.text)


def test_contaminated_documents_go_and_clean_ones_stay_unchanged(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    tainted = spark.createDataFrame([row(20, item), row(21, prose(40))], SCHEMA)
    got = cp.drop_contaminated(spark, docs.unionByName(tainted), SF)
    assert rows(got) == Counter(row(i, t) for i, t in TEXTS) + rows(tainted.where("doc_id = 21"))


def test_the_classifier_keeps_columns_and_drops_only(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'k' AS _key", "1 AS all")
    got = cp.keep_quality(spark, given, SF)
    assert got.columns == given.columns and 0 < got.count() < given.count()
    assert not rows(got) - rows(given)


def test_the_mixture_holds_each_document_as_often_as_it_is_taken(spark, docs):
    plan = {(r.doc_id, r.size): r for r in cp.plan_mixture(docs).collect()}
    got = cp.mix(spark, docs, SF).collect()
    assert len({(r.shard, r.place) for r in got}) > 1 and all({"doc_id", "shard", "place", "time"} <= set(r.asDict()) for r in got)
    times = Counter((r.doc_id, r["size"]) for r in got)
    total = sum(r.size * len(r.shards) for r in cp.plan_mixture(docs).collect())
    assert sum(r["size"] for r in got) == total and set(times) <= set(plan)


@pytest.mark.parametrize("stage", [cp.drop_near_copies, cp.cut_repeats, cp.drop_contaminated, cp.mix])
def test_empty_tables(spark, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).collect() == []
