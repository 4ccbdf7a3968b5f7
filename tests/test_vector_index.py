"""Stored vector index: recall, exact mode, stored form, and awkward inputs."""

import numpy as np
import pytest

from probatum.operators import vector_index as vi
from probatum.operators.vectors import vector_topk

CHUNK = "chunk_id long, embedding array<float>"
QUERY = "query_id long, query_vector array<double>"


def clustered(n=3000, width=18, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * 0.6


def frame(spark, matrix, schema=CHUNK):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], schema)


def answers(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.similarity) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    matrix = clustered()
    chunks = frame(spark, matrix).repartition(5)
    index = vi.build_index(chunks, str(tmp_path_factory.mktemp("index")))
    queries = frame(spark, matrix[:60] + np.random.default_rng(1).normal(size=(60, 18)) * 0.1, QUERY)
    return chunks, index, queries


def test_recall_is_reached_without_reading_all_cells(built):
    chunks, index, queries = built
    assert index.probes < len(index.centres) / 2
    got = vi.index_recall(vi.search_index(index, queries), vector_topk(chunks, queries)).toPandas()
    assert len(got) == 60 and got["found"].sum() >= 0.9 * got["expected"].sum()


def test_exact_mode_gives_the_rows_of_a_full_scan(built):
    chunks, index, queries = built
    assert answers(vi.search_exact(index, queries)) == answers(vector_topk(chunks, queries))


def test_similarities_are_exact_and_blocks_do_not_matter(built):
    chunks, index, queries = built
    one = answers(vi.search_index(index, queries))
    assert one == answers(vi.search_index(index, queries, block_bytes=18 * 8 * 25))
    full = {(q, c): s for q, _, c, s in answers(vector_topk(chunks, queries, 3000))}
    assert all(abs(full[q, c] - s) < 2e-6 for q, _, c, s in one)


def test_every_row_is_stored_once_and_only_probed_cells_are_read(spark, built):
    _, index, queries = built
    assert sorted(r.chunk_id for r in index.rows.select("chunk_id").collect()) == list(range(3000))
    assert {len(r.code) for r in index.rows.select("code").limit(20).collect()} == {5}
    scan = index.rows.where("cell IN (1, 2)").select("chunk_id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in scan and "embedding" not in scan


def test_an_opened_index_answers_alike(spark, built):
    _, index, queries = built
    assert answers(vi.search_index(vi.open_index(spark, index.path), queries)) == answers(vi.search_index(index, queries))


def test_added_rows_are_found(spark, tmp_path):
    matrix = clustered(400)
    index = vi.build_index(frame(spark, matrix[:300]), str(tmp_path / "i"))
    vi.add_to_index(index, frame(spark, matrix).where("chunk_id >= 300"))
    queries = frame(spark, matrix[300:330], QUERY)
    assert answers(vi.search_exact(index, queries)) == answers(vector_topk(frame(spark, matrix), queries))


def test_copies_fill_one_cell_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "FILE_ROWS", 50)
    matrix = np.concatenate([np.tile(np.arange(1.0, 9.0), (300, 1)), clustered(200, 8)])
    chunks, queries = frame(spark, matrix), frame(spark, matrix[298:304], QUERY)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    index = vi.build_index(chunks, str(tmp_path / "i"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = index.rows.where("chunk_id < 300").select("cell", "_metadata.file_path").distinct().collect()
    assert len({r.cell for r in hot}) == 1 and len(hot) > 1
    assert answers(vi.search_exact(index, queries)) == answers(vector_topk(chunks, queries))
    assert [c for q, _, c, _ in answers(vi.search_index(index, queries)) if q == 0] == list(range(10))


def test_awkward_vectors(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(1, [1.0, 0.0], "x"), (2, None, "y"), (3, [0.0, 0.0], "z"), (4, [float("nan"), 1.0], ""), (5, [None, 1.0], None),
         (6, [2.0, 0.0], "x"), (7, [0.0, 3.0], "x")], CHUNK + ", cell string")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], QUERY)
    index = vi.build_index(chunks, str(tmp_path / "i"))
    want = [(1, 1, 1, 1.0), (1, 2, 6, 1.0), (1, 3, 7, 0.0)]
    assert answers(vi.search_exact(index, queries)) == want
    assert answers(vi.search_index(index, queries, probes=9)) == want


def test_no_vectors_no_answers(spark, tmp_path):
    index = vi.build_index(spark.createDataFrame([], CHUNK), str(tmp_path / "i"))
    queries = spark.createDataFrame([(1, [1.0])], QUERY)
    assert answers(vi.search_index(index, queries)) == [] == answers(vi.search_exact(index, queries))
    assert index.rows.count() == 0 and answers(vi.search_index(vi.open_index(spark, index.path), queries)) == []
    with pytest.raises(ValueError, match="no cells"):
        vi.add_to_index(index, frame(spark, [[1.0]]))


def test_other_widths_are_refused(spark, built):
    _, index, _ = built
    with pytest.raises(ValueError, match="width"):
        vi.search_index(index, spark.createDataFrame([(1, [1.0, 2.0])], QUERY)).collect()


def test_ids_may_be_strings(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(30)], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [9.0, 1.0])], "query_id string, query_vector array<double>")
    index = vi.build_index(chunks, str(tmp_path / "i"))
    assert answers(vi.search_exact(index, queries, 3)) == answers(vector_topk(chunks, queries, 3))
