import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import vectors as V
from shelfwise.operators import vector_metrics as M


def _pairs(spark, n=30, d=6, seed=1):
    rng = np.random.default_rng(seed)
    A, B = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    rows = [(i, A[i].tolist(), B[i].tolist(), int(i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a array<double>, b array<double>, label int"), A, B


def _unit(x):
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


def test_normalize_pad_similarity(spark):
    df, A, B = _pairs(spark)
    zero = spark.createDataFrame([([0.0, 0.0],)], "a array<double>")
    assert zero.select(V.l2_normalize("a").alias("x")).first().x == [0.0, 0.0]
    r = df.orderBy("id").select(V.l2_normalize("a").alias("n"), V.pad_or_cut("a", 4).alias("c"),
                                V.pad_or_cut("a", 8).alias("p"), V.similarity("a", "b", "cosine").alias("cos"),
                                V.similarity("a", "b", "euclidean").alias("euc"), V.similarity("a", "b", "dot").alias("dot")).collect()
    for i, x in enumerate(r):
        assert np.allclose(x.n, _unit(A[i]))
        assert np.allclose(x.c, A[i][:4]) and np.allclose(x.p, list(A[i]) + [0, 0])
        assert np.isclose(x.cos, A[i] @ B[i] / np.linalg.norm(A[i]) / np.linalg.norm(B[i]))
        assert np.isclose(x.euc, 1 / (1 + np.linalg.norm(A[i] - B[i])))
        assert np.isclose(x.dot, A[i] @ B[i])


@pytest.mark.parametrize("method", ["weighted_average", "concatenate", "max_pooling", "attention_weighted"])
def test_fusion_methods_equal_numpy(spark, method):
    df, A, B = _pairs(spark)
    w = [0.7, 0.3]
    got = V.fuse_columns(df, ["a", "b"], "f", w, method).orderBy("id").select("f").collect()
    for i, r in enumerate(got):
        na, nb = _unit(A[i]), _unit(B[i])
        if method == "weighted_average":
            exp = _unit(w[0] * na + w[1] * nb)
        elif method == "concatenate":
            exp = np.concatenate([na, nb])
        elif method == "max_pooling":
            exp = np.maximum(na, nb)
        else:
            s = np.array([na @ nb * w[1], nb @ na * w[0]])
            a = np.exp(s - s.max())
            a /= a.sum()
            exp = _unit(a[0] * na + a[1] * nb)
        assert np.allclose(r.f, exp)


def test_fuse_argument_checks(spark):
    df, _, _ = _pairs(spark)
    with pytest.raises(ValueError, match="weights"):
        V.fuse_columns(df, ["a", "b"], "f", [1.0])
    with pytest.raises(ValueError, match="Unsupported"):
        V.fuse_columns(df, ["a", "b"], "f", None, "neural")


def test_present_fusion_falls_back_to_text(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], None)], "id int, a array<double>, b array<double>")
    r = V.fuse_present_columns(df, "a", "b", "f", 0.7, 0.3).first()
    assert np.allclose(r.f, [0.6, 0.8])


def test_embedding_quality_equals_pairwise(spark):
    df, A, _ = _pairs(spark, n=40)
    q = M.embedding_quality(df.select(F.col("id").alias("vec_id"), F.col("a").alias("embedding"))).first()
    S = A @ A.T
    off = S[~np.eye(len(A), dtype=bool)]
    norms = np.linalg.norm(A, axis=1)
    assert np.isclose(q.sim_mean, off.mean()) and np.isclose(q.sim_std, off.std())
    assert np.isclose(q.sim_min, off.min()) and np.isclose(q.sim_max, off.max())
    assert np.isclose(q.norm_mean, norms.mean()) and np.isclose(q.norm_std, norms.std())
    assert np.isclose(q.diversity_score, 1 - off.mean())


def test_dispersion_and_batch_losses(spark):
    df, A, B = _pairs(spark, n=37)
    got = M.category_dispersion(df.select(F.col("id").alias("vec_id"), F.col("a").alias("embedding"), "label"),
                                "label", block_rows=4).first()
    labels = np.arange(37) % 4
    exp = 0.0
    for c in range(4):
        X = A[labels == c]
        D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
        exp += D.mean() if len(X) > 1 else 0
    assert np.isclose(got.category_loss, exp / 4)
    one = df.withColumn("batch_id", F.lit(0))
    r = M.batch_losses(one, "batch_id", "a", "b", "label").first()
    T = A / np.linalg.norm(A, axis=1, keepdims=True)
    I = B / np.linalg.norm(B, axis=1, keepdims=True)
    L = T @ I.T / 0.07

    def ce(L):
        m = L.max(1, keepdims=True)
        return np.mean(m[:, 0] + np.log(np.exp(L - m).sum(1)) - np.diag(L))
    assert np.isclose(r.contrastive_loss, (ce(L) + ce(L.T)) / 2)
    assert np.isclose(r.total_loss, r.contrastive_loss + 0.1 * r.category_loss)


def test_hash_embed_is_unit_and_deterministic(spark):
    df = spark.createDataFrame([("red red blue",), ("",)], "t string")
    r = df.select(V.hash_embed("t", 16).alias("v")).collect()
    assert np.isclose(np.linalg.norm(r[0].v), 1.0) and sorted(r[0].v)[-1] > sorted(r[0].v)[-2]
    assert r[1].v == [0.0] * 16


def test_zero_vectors_have_no_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(V.similarity("a", "b", "cosine").alias("c")).collect()]
    assert got == [None, 1.0]
    empty = spark.createDataFrame([("",), (None,), ("word",)], "t string").select(V.hash_embed("t", 4).alias("v")).collect()
    assert empty[0].v == empty[1].v == [0.0] * 4 and sum(x * x for x in empty[2].v) == 1.0


def test_reports_of_too_few_vectors(spark):
    from shelfwise.operators import vector_metrics as VM
    one = spark.createDataFrame([(1, [3.0, 4.0], "a")], "vec_id long, embedding array<double>, c string")
    q = VM.embedding_quality(one).first()
    assert q.num_embeddings == 1 and q.norm_mean == 5.0 and q.sim_mean is None
    assert VM.embedding_quality(one.limit(0)).first().num_embeddings == 0
    assert VM.category_dispersion(one.limit(0), "c").first().category_loss is None
    hot = spark.createDataFrame([(i, [float(i), 0.0], None if i < 40 else "b") for i in range(50)], "vec_id long, embedding array<double>, c string")
    got = {r.category: r.mean_dist for r in VM.category_dispersion_by_group(hot, "c", block_rows=8).collect()}
    mean = lambda xs: sum(abs(a - b) for a in xs for b in xs) / len(xs) ** 2
    assert abs(got[None] - mean(range(40))) < 1e-9 and abs(got["b"] - mean(range(40, 50))) < 1e-9


@pytest.mark.parametrize("clustered", [True, False])
def test_dot_extremes_equal_all_pairs(spark, monkeypatch, clustered):
    r = np.random.default_rng(5)
    V = r.normal(size=(3000, 16)) if not clustered else np.repeat(r.normal(size=(60, 16)), 50, axis=0) + 0.02 * r.normal(size=(3000, 16))
    V[0] *= 3
    ids = list(range(3000))
    ids[1] = 0                       # a repeated id: no pair with itself
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, V)], "vec_id long, embedding array<double>, g int")
    for held in (64 << 20, 40_000):  # a few groups, many
        monkeypatch.setattr(M, "HELD_BYTES", held)
        got = M.dot_extremes(df).first()
        dots = V @ V.T
        dots[np.equal.outer(ids, ids)] = np.nan
        assert got["lo"] == pytest.approx(np.nanmin(dots), rel=1e-12) and got["hi"] == pytest.approx(np.nanmax(dots), rel=1e-12)
        assert 0 < got["visited"] <= got["tiles"]
        if clustered and held > 1 << 20:
            assert got["visited"] < 0.2 * got["tiles"]


def test_dot_extremes_odd_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert M.dot_extremes(make([])).first()[:3] == (None, None, 0)
    assert M.dot_extremes(make([(1, [1.0, 2.0]), (1, [3.0, 4.0])])).first()[:2] == (None, None)
    assert M.dot_extremes(make([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-2.0, 0.0])])).first()[:2] == (-2.0, 1.0)
    got = M.dot_extremes(make([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [2.0, 1.0])])).first()
    assert got[:2] == (2.0, 2.0)
    with pytest.raises(ValueError):
        M.dot_extremes(make([(1, [1.0]), (2, None)]))
    with pytest.raises(ValueError):
        M.dot_extremes(make([(1, [1.0]), (2, [1.0, 2.0])]))


def test_dispersion_of_a_hot_category_sends_a_vector_a_few_times(spark, monkeypatch):
    """Blocks of one row and cells of a few kilobytes: sums equal all pairs, null is a category."""
    X = np.random.default_rng(4).normal(size=(400, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in X[i]], None if i % 40 == 0 else int(i % 10 == 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(M, "HELD_BYTES", 8 * 8 * 64)
    sent, unpacked = spark.sparkContext.accumulator(0), M._cell_sums

    def counted(batches, kind):
        def seen():
            for b in batches:
                sent.add(sum(len(x) // 8 for x in b.column("ids").to_pylist()))
                yield b
        yield from unpacked(seen(), kind)
    monkeypatch.setattr(M, "_cell_sums", counted)
    got = {r.category: (r.n, r.mean_dist) for r in M.category_dispersion_by_group(df, "label", block_rows=1).collect()}
    for c in (None, 0, 1):
        C = X[[i for i, _, label in rows if label == c]].astype(np.float64)
        want = np.sqrt(((C[:, None] - C[None]) ** 2).sum(-1)).sum() / len(C) ** 2
        assert got[c][0] == len(C) and abs(got[c][1] - want) < 1e-6
    assert 400 <= sent.value <= 400 * (2 * np.sqrt(8 * spark.sparkContext.defaultParallelism) + 8)


def test_dispersion_counts_null_vectors_and_takes_a_dimension_per_category(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 1), (5, [0.0, 0.0, 2.0], 1), (6, None, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.category: (r.n, r.mean_dist) for r in M.category_dispersion_by_group(df, "label").collect()}
    assert got == {0: (3, pytest.approx(10 / 9)), 1: (2, pytest.approx(1.0)), 2: (1, 0.0)}
