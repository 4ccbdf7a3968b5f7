"""Every registered query against its check SQL, and plan properties that matter at scale."""

import glob

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["segment_articles", "segment_law", "segment_ruling", "chunk_overlap", "clean_text", "html_to_text"])
def test_row_work_needs_no_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    physical = text.split("== Physical Plan ==")[1]
    assert "Exchange" not in physical
    assert "Python" not in physical and "Pandas" not in physical


def test_rules_are_not_joined(spark):
    assert "Join" not in plan(QUERIES["rule_gate"](spark, SF)).split("== Physical Plan ==")[1]


def test_topk_keeps_few_rows_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["latest_queries"](spark, SF))


def test_statutes_get_their_type_and_number_without_a_join(spark):
    from probatum.catalog import derived
    from probatum.catalog.registry import Tables

    tables = Tables(spark, SF)
    found = derived.numbered_statutes(tables, "code")
    assert "Join" not in plan(found) and "Join" not in plan(QUERIES["chunk_documents"](spark, SF))
    pairs = lambda df: sorted(map(tuple, df.select("doc_id", "tipo", "numero").collect()))
    assert pairs(found) == pairs(derived.norms(tables))


def test_hybrid_lists_take_plain_texts_for_words_and_round_as_sql(spark, tmp_path):
    texts = ["the red or blue stone", "a -red stone \"or\" blue", "red or\nblue stone", "or stone avec red", "blue or red or stone", "... !", None]
    docs = [(i, (texts * 4)[i], "en", "web", 1) for i in range(24)] + [(30 + i, f"red {'stone ' * i}or blue the a", "en", "web", 1) for i in range(8)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(0, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(i, (texts * 4)[i]) for i in range(28)], "item_id long, text string"),
        "embeddings": ([(i, [1.0, float(i % 17), float(i % 5)], i % 10) for i in range(60)], "vec_id long, embedding array<float>, label int")}
    con = duckdb.connect()
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for query in ("hybrid_weighted", "hybrid_rrf"):
        got, want = QUERIES[query](spark, str(tmp_path)), con.sql(SQL[query])
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall()), query


def test_weighted_sums_are_rounded_as_sql_rounds_doubles(rows):
    from probatum.operators import fusion

    sums = [round(i / 1e6 + 0.39, 6) for i in range(1000)]
    hits = rows([(1, i, s) for i, s in enumerate(sums)], "query_id long, chunk_id long, similarity double")
    found = fusion.hybrid_weighted(hits, rows([], "query_id long, chunk_id long, score double"), 1000).collect()
    want = duckdb.sql("SELECT i, round(unnest($s) * 0.7::DOUBLE, 6) FROM (SELECT 1) t(i)", params={"s": sums}).fetchall()
    assert sorted(r.similarity for r in found) == sorted(w for _, w in want)
