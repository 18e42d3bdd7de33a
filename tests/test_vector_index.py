"""The stored vector index against exact search."""

import numpy as np
import pytest

from codeloom.operators import vector_index as vi
from codeloom.operators.vectors import embeddings, search_all


@pytest.fixture(scope="module")
def rows(spark, small):
    return embeddings(spark, small)


def exact(rows, queries, k):
    return {(r.query, r.vec_id, r["rank"]) for r in search_all(vi.usable(rows), vi.usable(queries), k).collect()}


def found(df):
    return {(r.query, r.vec_id, r["rank"]) for r in df.collect()}


def test_recall_grows_with_probes_to_that_of_exact_search(spark, rows, tmp_path):
    index = vi.VectorIndex(spark, str(tmp_path / "i"))
    index.build(rows, 16)
    queries = rows.filter("vec_id % 100 = 0")
    measured = [vi.recall(index, rows, queries, 5, p) for p in (1, 6, 16)]
    assert measured[0] < measured[1] and measured[2] == 1 and measured[1] >= 0.5
    assert found(index.search_exact(queries, 5, 2)) == exact(rows, queries, 5)
    assert index.rows().count() == rows.count()


def test_clustered_vectors_are_found_with_few_probes(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 10
    data = [(k, (centres[k % 20] + rng.normal(size=8)).tolist()) for k in range(2000)]
    rows = spark.createDataFrame(data, vi.ROW)
    index = vi.VectorIndex(spark, str(tmp_path / "i"))
    index.build(rows, 20)
    queries = rows.filter("vec_id % 50 = 0")
    assert vi.recall(index, rows, queries, 10, 2) >= 0.9
    assert found(index.search_exact(queries, 10)) == exact(rows, queries, 10)


def test_upserts_deletions_and_odd_rows(spark, tmp_path):
    index = vi.VectorIndex(spark, str(tmp_path / "i"))
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [1.0]), (None, [1.0, 1.0])], vi.ROW)
    index.build(rows.filter("size(embedding) <> 1 or embedding is null"), 2)
    index.upsert(spark.createDataFrame([(2, [5.0, 0.0]), (6, [1.0])], vi.ROW), spark.createDataFrame([(1,)], "vec_id long"))
    assert {(r.vec_id, tuple(r.embedding)) for r in index.rows().collect()} == {(2, (5.0, 0.0)), (3, (1.0, 0.0))}
    query = spark.createDataFrame([(9, [1.0, 0.0]), (10, None)], vi.ROW)
    assert found(index.search_exact(query, 3)) == {(9, 3, 1), (9, 2, 2)}
    empty = vi.VectorIndex(spark, str(tmp_path / "e"))
    empty.build(rows.limit(0), 4)
    assert empty.search(query, 3, 1).count() == 0


def test_many_pairs_meet_in_blocks_of_lists(spark, rows, tmp_path, monkeypatch):
    index = vi.VectorIndex(spark, str(tmp_path / "i"))
    index.build(rows, 16)
    queries = rows.filter("vec_id % 100 = 0")
    monkeypatch.setattr(vi, "PROBES", 0)
    monkeypatch.setattr(vi, "BLOCK", 3)
    monkeypatch.setattr(vi, "CHUNK", 20)
    df = index.search(queries, 5, 16)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
    assert found(df) == exact(rows, queries, 5)


def test_many_queries_take_little_memory_and_find_the_nearest():
    import tracemalloc

    from codeloom.operators.vectors import best_of

    rng = np.random.default_rng(4)
    m = rng.normal(size=(5000, 16))
    m[1000:1020] = m[7]  # copies
    tracemalloc.start()
    q, i, d = best_of(np.arange(4096), m[:4096], np.arange(5000), m, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    assert len(q) == 5 * 4096 and i[q == 7].tolist() == [7, 1000, 1001, 1002, 1003] and d[q == 7].max() == 0
    true = np.sqrt(((m[:50, None] - m[None]) ** 2).sum(-1))
    for k in range(50):
        assert set(i[q == k][:3]) == set(np.lexsort((np.arange(5000), true[k]))[:3])
