import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ann, knn, search
from shelfwise.operators.knn import compared_pairs, knn_join


def _vecs(spark, n=60, d=8, seed=0, dup=True):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)).astype(np.float32)
    if dup:
        X[5] = X[3]  # exact duplicate: tie broken by id
    rows = [(int(i), [float(x) for x in X[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), X.astype(np.float64)


def _brute(X, Q, qids, k, metric, exclude_self=False):
    out = {}
    for qi, q in zip(qids, Q):
        s = ((X - q) ** 2).sum(1) if metric == "l2" else -(X @ q)
        if exclude_self:
            s = s.copy()
            s[qi] = np.inf
        order = np.lexsort((np.arange(len(X)), s))[:k]
        out[qi] = [int(i) for i in order if np.isfinite(s[i])]
    return out


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("block_rows", [1024, 7])
def test_exact_search_equals_brute_force(spark, metric, block_rows):
    v, X = _vecs(spark)
    q = v.withColumnRenamed("vec_id", "query_id")
    got = knn_join(q, v, k=4, metric=metric, exclude_self=True, block_rows=block_rows).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.vec_id)
    assert res == _brute(X, X, range(len(X)), 4, metric, exclude_self=True)


def test_per_query_k_and_scores(spark):
    v, X = _vecs(spark, dup=False)
    q = v.select(F.col("vec_id").alias("query_id"), "embedding", (F.col("vec_id") % 3 + 1).alias("k"))
    got = knn_join(q, v, k_col="k").collect()
    counts = {}
    for r in got:
        counts[r.query_id] = counts.get(r.query_id, 0) + 1
        if r.rank == 1:
            assert r.vec_id == r.query_id and abs(r.score) < 1e-12  # squared L2 of itself
    assert all(counts[i] == i % 3 + 1 for i in range(len(X)))


def test_empty_index_gives_no_rows_and_message(spark):
    v, _ = _vecs(spark)
    empty = search.clear(v)
    q = v.withColumnRenamed("vec_id", "query_id")
    hits = knn_join(q, empty, k=3)
    assert hits.count() == 0
    msg = search.with_no_result_rows(q, hits).select("message").distinct().collect()
    assert len(msg) == 1 and msg[0].message.startswith("I'm sorry")


def test_remove_add_stats(spark):
    v, _ = _vecs(spark, n=5, d=128, dup=False)
    ids = spark.createDataFrame([(1,), (3,)], "vec_id long")
    left = search.remove_vectors(v, ids)
    assert sorted(r.vec_id for r in left.collect()) == [0, 2, 4]
    s = search.index_stats(left).first()
    assert (s.total_vectors, s.dimension, s.index_type) == (3, 128, "flat")
    assert abs(s.memory_usage_mb - 3 * 128 * 4 / 2 ** 20) < 1e-12
    both = search.add_vectors(left, v.where("vec_id = 1"))
    assert both.count() == 4


def test_add_checks(spark):
    v, _ = _vecs(spark, n=4, d=8, dup=False)
    meta = spark.createDataFrame([(0,), (1,), (2,)], "vec_id long")
    with pytest.raises(ValueError, match="match number of metadata"):
        search.check_add(v, meta, 8)
    full = spark.createDataFrame([(i,) for i in range(4)], "vec_id long")
    with pytest.raises(ValueError, match="dimension"):
        search.check_add(v, full, 16)
    search.check_add(v, full, 8)


def test_ivf_all_probes_is_exact_and_needs_enough_rows(spark):
    v, X = _vecs(spark, n=50, d=16, dup=False)
    idx = ann.train_ivf(v, nlist=10)
    q = v.withColumnRenamed("vec_id", "query_id")
    got = ann.ivf_search(q, idx, k=3, nprobe=10).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.vec_id)
    assert res == _brute(X, X, range(50), 3, "l2")
    few, _ = _vecs(spark, n=5, d=16, dup=False)
    with pytest.raises(ValueError, match="at least 10"):
        ann.train_ivf(few, nlist=10)


def test_ivf_in_small_blocks_is_exact_with_all_probes(spark):
    v, X = _vecs(spark, n=60, d=8, dup=False)
    idx = ann.train_ivf(v, nlist=6)
    q = v.withColumnRenamed("vec_id", "query_id")
    got = ann.ivf_search(q, idx, k=3, nprobe=6, block_rows=5).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.vec_id)
    assert res == _brute(X, X, range(60), 3, "l2")


def test_ivf_restricts_to_probed_clusters(spark):
    v, _ = _vecs(spark, n=80, d=8, dup=False)
    idx = ann.train_ivf(v, nlist=8)
    q = v.withColumnRenamed("vec_id", "query_id")
    got = ann.ivf_search(q, idx, k=5, nprobe=1)
    probes = ann.probe_lists(q, idx, 1)
    chk = (got.join(probes, "query_id").join(idx.vectors.select("vec_id", "cluster_id"), "vec_id")
           .where(~F.array_contains("probes", F.col("cluster_id"))))
    assert chk.count() == 0


def test_lsh_search_returns_exact_scores(spark):
    v, X = _vecs(spark, n=40, d=8, dup=False)
    idx = ann.train_lsh(v, num_tables=4)
    q = v.withColumnRenamed("vec_id", "query_id")
    for r in ann.lsh_search(q, idx, k=3).collect():
        assert abs(r.score - ((X[r.query_id] - X[r.vec_id]) ** 2).sum()) < 1e-9


def test_encoder_plug_point(spark):
    import numpy as np

    from shelfwise.plans.retrieval import embed_products
    meta = spark.createDataFrame([(1, "ab"), (2, "abcd")], "product_id long, combined_text string")
    enc = lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = {r.vec_id: r.embedding for r in embed_products(meta, encoder=enc).collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0]}


def test_ivf_add_assigns_new_vectors(spark):
    v, X = _vecs(spark, n=70, d=8, dup=False)
    with pytest.raises(ValueError, match="train_if_needed"):
        ann.ivf_add(None, v.where("vec_id < 50"), nlist=5, train_if_needed=False)
    idx = ann.ivf_add(None, v.where("vec_id < 50"), nlist=5)
    idx = ann.ivf_add(idx, v.where("vec_id >= 50"))
    assert idx.vectors.count() == 70 and idx.vectors.where("cluster_id IS NULL").count() == 0
    q = v.withColumnRenamed("vec_id", "query_id")
    got = ann.ivf_search(q, idx, k=2, nprobe=5).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        res.setdefault(r.query_id, []).append(r.vec_id)
    assert res == _brute(X, X, range(70), 2, "l2")


def test_hot_key_is_cut_into_bounded_blocks(spark, monkeypatch):
    """One cluster holds 90% of queries and vectors; no visit sees more than a block of each."""
    v, X = _vecs(spark, n=400, d=8, dup=False)
    keyed = v.withColumn("c", F.when(F.col("vec_id") % 10 == 0, 1).otherwise(0).cast("long"))
    q = keyed.withColumnRenamed("vec_id", "query_id").withColumn("c", F.array("c"))
    got = {}
    for r in knn_join(q, keyed, k=3, query_keys_col="c", vec_keys_col="c", block_rows=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for c in (0, 1):
        ids = [i for i in range(400) if (i % 10 == 0) == (c == 1)]
        want = _brute(X[ids], X[ids], range(len(ids)), 3, "l2")
        for i, q_id in enumerate(ids):
            assert [v for _, v in sorted(got[q_id])] == [ids[j] for j in want[i]]
    # hash blocks of 16 rows on average: the largest of 23 stays well below three times that
    blocks = (keyed.filter("c = 0").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(23))).groupBy("b").count())
    assert blocks.agg(F.max("count")).first()[0] <= 48


def test_lsh_compares_fewer_pairs_than_exact_search(spark):
    v, _ = _vecs(spark, n=300, d=16, dup=False)
    idx = ann.train_lsh(v, num_tables=4, bits=8)
    pairs = ann.lsh_compared_pairs(v, idx)
    assert 300 <= pairs < 300 * 300 / 4


def test_ivf_compares_probed_pairs_only(spark):
    v, _ = _vecs(spark, n=300, d=16, dup=False)
    idx = ann.train_ivf(v, nlist=10)
    probes = ann.probe_lists(v.withColumnRenamed("vec_id", "query_id"), idx, 2)
    assert compared_pairs(probes, idx.vectors, "probes", "cluster_id") < 300 * 300 / 2


def test_mixed_dimensions_and_missing_vectors_raise(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="dimensions 2 to 3"):
        knn_join(q, mixed, k=2)
    missing = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="1 vectors have no vector"):
        knn_join(q, missing, k=2)


def test_sign_buckets_do_not_depend_on_the_machine():
    planes = ann.sign_planes(4, 2, 3)
    assert planes.shape == (6, 4) and set(planes.ravel().tolist()) == {1, -1}
    assert planes.tolist() == ann.sign_planes(4, 2, 3).tolist()


def test_dimension_mismatch_raises(spark):
    v, _ = _vecs(spark, n=5, d=8, dup=False)
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    with pytest.raises(ValueError, match="dimension 2 doesn't match index dimension 8"):
        knn_join(q, v, k=2)


def test_keyed_rows_are_sent_a_few_times_whatever_the_size_of_a_key(spark, monkeypatch):
    """A hot key of 63 blocks: a query is not sent to each of them."""
    v, X = _vecs(spark, n=1000, d=8, dup=False)
    keyed = v.withColumn("c", F.when(F.col("vec_id") % 10 == 0, 1).otherwise(0).cast("long"))
    q = keyed.withColumnRenamed("vec_id", "query_id").withColumn("c", F.array("c"))
    sent, met = [], knn._met

    def counted(*args):
        rows = met(*args)
        sent.append({r[0]: r[1] / 8 for r in rows.groupBy("side").agg(F.sum(F.length("ids"))).collect()})
        return rows
    monkeypatch.setattr(knn, "_met", counted)
    got = {}
    for r in knn_join(q, keyed, k=3, query_keys_col="c", vec_keys_col="c", block_rows=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for c in (0, 1):
        ids = [i for i in range(1000) if (i % 10 == 0) == (c == 1)]
        want = _brute(X[ids], X[ids], range(len(ids)), 3, "l2")
        for i, q_id in enumerate(ids):
            assert [v for _, v in sorted(got[q_id])] == [ids[j] for j in want[i]]
    most = 2 * np.sqrt(4 * spark.sparkContext.defaultParallelism)
    assert 1000 <= sent[0][0] <= most * 1000 and 1000 <= sent[0][1] <= most * 1000


def test_many_equally_near_vectors_are_scored_some_at_a_time():
    import tracemalloc

    from shelfwise.operators.knn import _Column
    vecs = np.tile(np.arange(64.0), (5000, 1))
    ids = np.arange(5000)
    column = _Column(ids[::-1].copy(), ids[::-1].copy(), vecs, "l2")
    tracemalloc.start()
    qi, score, found = column.nearest(vecs[:512] + 1.0, ids[:512], 3, True, 1e-9, 9, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600e6, peak  # all at once: some GB
    assert np.array_equal(qi, np.repeat(np.arange(512), 3)) and set(score) == {64.0}
    assert found[:9].tolist() == [1, 2, 3, 0, 2, 3, 0, 1, 3]


def test_products_are_compared_in_parts_and_merged_seldom(monkeypatch):
    # products of 1,024 queries were made anew for every 4,096 vectors, and those found merged each time
    monkeypatch.setattr(knn, "_VECTORS_AT_ONCE", 512)
    monkeypatch.setattr(knn, "_IN_CACHE", 4096)
    merges = []
    monkeypatch.setattr(knn, "_best", lambda *a, f=knn._best: (merges.append(1), f(*a))[1])
    rng = np.random.default_rng(7)
    vecs = rng.integers(-3, 4, (12_000, 6)).astype(float)  # many equally near
    ids, own = np.arange(12_000), np.arange(12_000) // 3
    for metric in ("l2", "ip"):
        merges.clear()
        qi, score, found = knn._Column(ids, own, vecs, metric).nearest(vecs[:300], own[:300], 4, True, 1e-9, 9, False)
        for i in range(0, 300, 29):
            s = ((vecs - vecs[i]) ** 2).sum(1) if metric == "l2" else -(vecs @ vecs[i])
            s = np.where(own == own[i], np.inf, s)
            assert found[qi == i].tolist() == np.lexsort((ids, s))[:4].tolist()
        assert len(merges) < 15  # of 23 parts


def test_every_cell_is_a_task_of_its_own(spark):
    kind = "key bigint, g int, ids binary, ks binary, own binary, vecs binary"
    side = lambda n: spark.createDataFrame([(0, g, b"", b"", b"", b"") for g in range(n)], kind)
    met = knn._met(side(8), side(3), None, F.lit(3), F.lit(8), 24).withColumn("task", F.spark_partition_id())
    cells = met.groupBy("task").agg(F.count_distinct("i", "j").alias("n"), F.count("side").alias("rows")).collect()
    assert [(r.n, r.rows) for r in cells] == [(1, 2)] * 24
