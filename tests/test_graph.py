import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ann, graph
from shelfwise.operators.knn import grid, knn_join


def clustered(n=1500, clusters=40, dim=16, spread=0.35, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return (centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")


def queries_of(df):
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def brute(x, q, k, own=None):
    d = ((q[:, None, :].astype(float) - x[None, :, :].astype(float)) ** 2).sum(axis=2)
    if own is not None:
        d[np.arange(len(q)), own] = np.inf
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


def test_graph_finds_nine_tenths_with_less_than_a_third_of_the_pairs(spark):
    df = frame(spark, clustered())
    row = graph.graph_recall(queries_of(df), df, graph.build_graph(df, m=12), 5, 32, exclude_self=True).first()
    assert row.recall >= 0.9
    assert row.built_share <= 1 / 3 and row.searched_share <= 1 / 3


def test_graph_scores_are_exact_and_copies_come_back(spark):
    x = clustered(120, 6)
    x = np.concatenate([x, np.repeat(x[:1], 90, axis=0)])   # a large group of copies
    df = frame(spark, x)
    index = graph.build_graph(df, m=8)
    assert index.size == 120 and index.copies.count() == 119 + 64
    got = graph.graph_search(queries_of(df), index, k=5, beam=64, exclude_self=True).collect()
    assert len(got) == 5 * len(x)
    for r in got:
        assert r.query_id != r.vec_id
        assert r.score == pytest.approx(float(((x[r.query_id].astype(float) - x[r.vec_id]) ** 2).sum()), abs=1e-6)
    _, exact = brute(x, x, 5, np.arange(len(x)))
    found = {(r.query_id, r["rank"]): r.score for r in got}
    close = [abs(found[i, j + 1] - exact[i, j]) < 1e-6 for i in range(len(x)) for j in range(5)]
    assert np.mean(close) > 0.95
    with pytest.raises(ValueError):
        graph.graph_search(queries_of(df), index, k=64)


def test_graph_of_no_or_one_vector(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    one = spark.createDataFrame([(7, [1.0, 2.0]), (8, None)], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    assert graph.graph_search(q, graph.build_graph(none), 3).collect() == []
    assert [tuple(r) for r in graph.graph_search(q, graph.build_graph(one), 3).collect()] == [(1, 1, 7, 5.0)]
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError):
        graph.build_graph(mixed)


def test_bounded_clusters_equal_exact_search_and_visit_few(spark):
    x = clustered(800, 20, spread=0.15)
    df = frame(spark, x)
    index = ann.train_ivf(df, nlist=20)
    exact = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn_join(queries_of(df), df, 5, exclude_self=True).collect()}
    got = ann.ivf_search_exact(queries_of(df), index, 5, exclude_self=True).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == exact
    assert np.mean([r.clusters_visited for r in got]) <= 20 / 3
    early = ann.ivf_search_exact(queries_of(df), index, 5, exclude_self=True, epsilon=0.5).collect()
    assert np.mean([r.clusters_visited for r in early]) <= np.mean([r.clusters_visited for r in got])
    assert all(r.score <= 1.5 ** 2 * exact[r.query_id, r["rank"]][1] + 1e-9 for r in early)
    with pytest.raises(ValueError):
        ann.ivf_search_exact(queries_of(df), ann.IvfIndex(index.vectors, index.centroids, 20, "ip"), 5)


def test_bounded_clusters_with_few_vectors_and_outside_queries(spark):
    x = clustered(30, 3)
    df = frame(spark, x)
    index = ann.train_ivf(df, nlist=3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(5, 3, seed=9) * 3)], "query_id bigint, embedding array<float>")
    for k in (4, 50):  # more than there are
        want = sorted((r.query_id, r["rank"], r.vec_id) for r in knn_join(q, df, k).collect())
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.ivf_search_exact(q, index, k).collect()) == want


def test_grid_copies_grow_with_the_root_of_the_tasks():
    for n in (10_000, 100_000, 1_000_000):
        gq, gv = grid(n, n, 16, 8)
        assert 28 <= gq * gv <= 36 and max(gq, gv) <= 7       # 32 cells: 5 or 6 copies of either side
    gq, gv = grid(1_000, 10_000_000, 16, 8)             # few queries: they are copied, the vectors are not
    assert gq == 1 and gv >= 20
    assert grid(10, 10, 4, 8) == (1, 1)
    assert grid(10 ** 6, 10 ** 9, 64, 100)[1] >= 8 * 64 * 10 ** 9 // (64 << 20)  # a cell's vectors fit a task


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_grid_of_many_cells_equals_brute_force(spark, metric):
    x = clustered(700, 10)
    q = clustered(90, 10, seed=4)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, embedding array<float>")
    got = knn_join(qs.repartition(3), frame(spark, x).repartition(5), 7, metric, block_rows=16).collect()
    s = ((q[:, None].astype(float) - x[None]) ** 2).sum(axis=2) if metric == "l2" else -(q.astype(float) @ x.T.astype(float))
    want = np.argsort(s, axis=1, kind="stable")[:, :7]
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(i, j + 1): int(want[i, j]) for i in range(90) for j in range(7)}


def test_grid_beyond_the_range_of_float32(spark):
    rows = [(0, [1e25, 0.0]), (1, [2e25, 0.0]), (2, [1e25, 1e20]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = knn_join(queries_of(df), df, 3, exclude_self=True).collect()
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {
        (0, 1): 2, (0, 2): 1, (0, 3): 3, (1, 1): 0, (1, 2): 2, (1, 3): 3, (2, 1): 0, (2, 2): 1, (2, 3): 3,  # a tie
        (3, 1): 0, (3, 2): 2, (3, 3): 1}
