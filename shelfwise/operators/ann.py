"""Approximate search: inverted file (N3), sign-projection LSH (N4), comparison.

IVF: a centroid table (seeded KMeans of ``pyspark.ml``, or given by the caller);
every vector gets the id of its nearest centroid (L2, for either metric). A query
probes its ``nprobe`` nearest centroids and is compared only with the vectors of
those clusters: query and vectors meet by equality on (cluster, block), so only
probed pairs are computed and a large cluster is many blocks. On an index stored
``partitionBy(cluster_id)``, ``restrict_to_probed`` prunes the files of clusters no
query probes.

LSH: ``num_tables`` hash tables; a vector's bucket in a table is the signs of
``bits`` projections on vectors of +1 and -1 drawn from an md5 of (table, bit,
component), on components scaled to integers, so buckets are the same on every
machine. Candidates meet by equality on (table, bucket) and are scored exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import IVF_NLIST, IVF_NPROBE
from ..sources.io import load_index, materialise
from .knn import BLOCK_ROWS, compared_pairs, knn_join


class IvfIndex:
    """Trained IVF: vectors with ``cluster_id`` plus the centroid table."""

    def __init__(self, vectors: DataFrame, centroids: DataFrame, nlist: int, metric: str = "l2"):
        self.vectors = vectors          # (vec_id, embedding, cluster_id)
        self.centroids = centroids      # (cluster_id, centroid array<double>)
        self.nlist = nlist
        self.metric = metric


def train_ivf(vectors: DataFrame, nlist: int = IVF_NLIST, metric: str = "l2", seed: int = 7,
              max_iter: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> IvfIndex:
    """N3 training; needs at least ``nlist`` vectors like the reference."""
    n = vectors.count()
    if n < nlist:
        raise ValueError(f"an IVF index of {nlist} clusters takes at least {nlist} vectors, not {n}")
    feats = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"),
                           array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features",
                   predictionCol="cluster_id").fit(feats)
    cents = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = vectors.sparkSession.createDataFrame(cents, T.StructType([
        T.StructField("cluster_id", T.LongType()), T.StructField("centroid", T.ArrayType(T.DoubleType()))]))
    assigned = model.transform(feats).select("vec_id", "embedding", F.col("cluster_id").cast("long"))
    return IvfIndex(assigned, centroids, nlist, metric)


def _assign(vectors: DataFrame, centroids: DataFrame, tie_decimals: int | None = None) -> DataFrame:
    """Vectors with the id of their nearest centroid."""
    near = knn_join(vectors.withColumnRenamed("vec_id", "query_id"), centroids, k=1, metric="l2",
                    vec_id_col="cluster_id", vec_col="centroid", tie_decimals=tie_decimals)
    return vectors.join(near.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("cluster_id")), "vec_id")


def ivf_from_centroids(vectors: DataFrame, centroids: DataFrame, metric: str = "l2",
                       tie_decimals: int | None = None) -> IvfIndex:
    """An index over the caller's centroids ``(cluster_id, centroid)``."""
    rows = _assign(vectors.select("vec_id", "embedding"), centroids, tie_decimals)
    return IvfIndex(materialise(rows, "ivf-vectors"), centroids, centroids.count(), metric)


def load_ivf(spark, path: str) -> IvfIndex:
    """A saved IVF index, ready to be searched and added to."""
    vectors, centroids, _, manifest = load_index(spark, path)
    if not manifest["is_trained"] or centroids is None:
        raise ValueError(f"{path} holds no trained IVF index")
    return IvfIndex(vectors.select("vec_id", "embedding", "cluster_id"), centroids, manifest["n_centroids"],
                    manifest.get("metric", "l2"))


def ivf_add(index: IvfIndex | None, vectors: DataFrame, nlist: int = IVF_NLIST, metric: str = "l2",
            train_if_needed: bool = True, id_col: str = "vec_id", vec_col: str = "embedding") -> IvfIndex:
    """N6 for IVF: train on the first add (if allowed), else assign new vectors to
    their nearest existing centroid. Vectors of another dimension raise."""
    if index is None:
        if not train_if_needed:
            raise ValueError("this IVF index is untrained and train_if_needed is False")
        return train_ivf(vectors, nlist, metric, id_col=id_col, vec_col=vec_col)
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    added = _assign(v, index.centroids).select("vec_id", "embedding", "cluster_id")
    return IvfIndex(index.vectors.unionByName(added), index.centroids, index.nlist, index.metric)


def probe_lists(queries: DataFrame, index: IvfIndex, nprobe: int = IVF_NPROBE,
                query_id_col: str = "query_id", query_vec_col: str = "embedding",
                tie_decimals: int | None = None) -> DataFrame:
    """``(query_id, probes array<long>)``: the ``nprobe`` nearest centroids by L2."""
    near = knn_join(queries, index.centroids, k=min(nprobe, index.nlist), metric="l2",
                    query_id_col=query_id_col, query_vec_col=query_vec_col,
                    vec_id_col="cluster_id", vec_col="centroid", tie_decimals=tie_decimals)
    return near.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("probes"))


def restrict_to_probed(index: IvfIndex, probes: DataFrame) -> IvfIndex:
    """Only the clusters some query probes. Their ids, ``nlist`` at most, become a
    filter on ``cluster_id``, which prunes the partitions of a stored index."""
    ids = [r[0] for r in probes.select(F.explode("probes")).distinct().collect()]
    return IvfIndex(index.vectors.where(F.col("cluster_id").isin(ids)), index.centroids, index.nlist, index.metric)


def ivf_search(queries: DataFrame, index: IvfIndex, k: int = 10, nprobe: int = IVF_NPROBE, *,
               query_id_col: str = "query_id", query_vec_col: str = "embedding",
               exclude_self: bool = False, tie_decimals: int | None = None, prune: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` searching only probed clusters.
    ``prune`` reads only the probed partitions of a stored index."""
    probes = materialise(probe_lists(queries, index, nprobe, query_id_col, query_vec_col, tie_decimals), "probes")
    if prune:
        index = restrict_to_probed(index, probes)
    q = (queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vec_col).alias("qvec"))
         .join(probes, "query_id"))
    return knn_join(q, index.vectors, k=k, metric=index.metric, query_vec_col="qvec", query_keys_col="probes",
                    vec_keys_col="cluster_id", exclude_self=exclude_self, tie_decimals=tie_decimals, block_rows=block_rows)


def cluster_radii(index: IvfIndex) -> DataFrame:
    """``(cluster_id, radius)``: the largest distance of a cluster's vectors from its centroid."""
    d = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), "centroid", lambda x, c: (x - c) * (x - c)),
                    F.lit(0.0), lambda a, x: a + x)
    return index.vectors.join(F.broadcast(index.centroids), "cluster_id").groupBy("cluster_id").agg(F.sqrt(F.max(d)).alias("radius"))


def cluster_bounds(queries: DataFrame, index: IvfIndex, query_id_col: str = "query_id", query_vec_col: str = "embedding") -> DataFrame:
    """``(query_id, bounds array<struct<low, cluster_id>>)``, rising: by the triangle inequality no
    vector of the cluster has a squared distance under ``low`` (less a margin for float noise)."""
    near = knn_join(queries, index.centroids, k=index.nlist, metric="l2", query_id_col=query_id_col,
                    query_vec_col=query_vec_col, vec_id_col="cluster_id", vec_col="centroid")
    gap = F.greatest(F.sqrt("score") - F.col("radius") - 1e-7, F.lit(0.0))
    return (near.withColumnRenamed("vec_id", "cluster_id").join(F.broadcast(cluster_radii(index)), "cluster_id")
            .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((gap * gap).alias("low"), "cluster_id"))).alias("bounds")))


def ivf_search_exact(queries: DataFrame, index: IvfIndex, k: int = 10, *, query_id_col: str = "query_id",
                     query_vec_col: str = "embedding", exclude_self: bool = False, tie_decimals: int | None = None,
                     epsilon: float = 0.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """N3 without loss: ``(query_id, rank, vec_id, score, clusters_visited)``, equal to exact search.

    A query visits its clusters by rising lower bound, 1, 2, 4, ... a round, and ends when no
    unvisited bound is at most its k-th score. ``epsilon`` ends it earlier: every score is then
    at most ``(1 + epsilon)^2`` times the exact one of its rank. Squared L2 only. Centroids are
    ``nlist`` rows (a parameter), which bounds what is broadcast; rounds are at most log2(nlist) + 1.
    """
    if index.metric != "l2":
        raise ValueError("bounds by the triangle inequality hold for L2 only")
    q = queries.select(F.col(query_id_col).cast("long").alias("query_id"), F.col(query_vec_col).alias("qvec"))
    hit = "array<struct<score:double,vec_id:bigint>>"
    state = materialise(q.join(cluster_bounds(queries, index, query_id_col, query_vec_col), "query_id").select(
        "query_id", "qvec", "bounds", F.lit(0).alias("visited"), F.array().cast(hit).alias("hits")), "ivf-exact")
    step = 1
    # a cluster must be visited while k are not found or its bound does not exceed the k-th score
    factor = (1.0 + epsilon) ** 2
    slack = 1e-9 if tie_decimals is None else 10.0 ** -tie_decimals
    while True:
        worst = F.when(F.size("hits") >= k, F.element_at("hits", -1)["score"] + slack).otherwise(F.lit(float("inf")))
        ahead = F.slice("bounds", F.col("visited") + 1, F.lit(step))
        todo = F.transform(F.filter(ahead, lambda b: b["low"] * factor <= worst), lambda b: b["cluster_id"])
        rows = state.withColumn("todo", todo)
        active = rows.where(F.size("todo") > 0)
        if not active.limit(1).count():
            break
        found = knn_join(active, index.vectors, k=k, query_vec_col="qvec", query_keys_col="todo", vec_keys_col="cluster_id",
                         exclude_self=exclude_self, tie_decimals=tie_decimals, block_rows=block_rows)
        found = found.groupBy("query_id").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))
        state = materialise(rows.join(found, "query_id", "left").select(
            "query_id", "qvec", "bounds", (F.col("visited") + F.size("todo")).alias("visited"),
            F.slice(F.array_sort(F.concat("hits", F.coalesce("found", F.array().cast(hit)))), 1, k).alias("hits")), "ivf-exact")
        step *= 2
    return state.select("query_id", F.posexplode("hits").alias("pos", "x"), "visited").select(
        "query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score", F.col("visited").cast("long").alias("clusters_visited"))


# -- N4 -----------------------------------------------------------------------

LSH_TABLES, LSH_BITS = 8, 8
# Chosen by measured recall@5 against exact search on nearly orthogonal vectors: 0.9 or more.
LSH_RECALL_TABLES, LSH_RECALL_BITS = 20, 4
LSH_SCALE = 1 << 20


def sign_planes(dim: int, num_tables: int, bits: int) -> np.ndarray:
    """(tables * bits, dim) of +1 and -1: the first hex digit of an md5 is 8 or more, or less."""
    def sign(t, b, c):
        return 1 if hashlib.md5(f"{t}:{b}:{c}".encode()).hexdigest()[0] >= "8" else -1
    return np.array([[sign(t, b, c) for c in range(dim)] for t in range(num_tables) for b in range(bits)], np.int64)


class LshIndex:
    def __init__(self, vectors: DataFrame, dim: int, num_tables: int, bits: int):
        self.vectors = vectors      # (vec_id, embedding, buckets array<long>)
        self.dim = dim
        self.num_tables = num_tables
        self.bits = bits


def with_buckets(df: DataFrame, vec_col: str, dim: int, num_tables: int, bits: int) -> DataFrame:
    """``df`` and ``buckets``: one number per table, ``table * 2^bits + signs``."""
    planes = sign_planes(dim, num_tables, bits)
    weights = 1 << np.arange(bits)[::-1]

    @F.pandas_udf("array<bigint>")
    def buckets(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        whole = np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * LSH_SCALE).astype(np.int64)
        signs = (whole @ planes.T >= 0).reshape(len(whole), num_tables, bits)
        return pd.Series(list((signs * weights).sum(axis=2) + (np.arange(num_tables) << bits)))
    return df.withColumn("buckets", buckets(F.col(vec_col)))


def train_lsh(vectors: DataFrame, num_tables: int = LSH_TABLES, bits: int = LSH_BITS,
              id_col: str = "vec_id", vec_col: str = "embedding") -> LshIndex:
    """N4 hashing; nothing is learnt but the dimension."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    dim = v.agg(F.max(F.size("embedding"))).first()[0] or 1
    return LshIndex(with_buckets(v, "embedding", dim, num_tables, bits), dim, num_tables, bits)


def lsh_search(queries: DataFrame, index: LshIndex, k: int = 10, metric: str = "l2", *,
               query_id_col: str = "query_id", query_vec_col: str = "embedding",
               exclude_self: bool = False, tie_decimals: int | None = None) -> DataFrame:
    """Exact scores of the candidates that share a bucket in some table."""
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).alias("qvec"))
    qb = with_buckets(q, "qvec", index.dim, index.num_tables, index.bits)
    return knn_join(qb, index.vectors, k=k, metric=metric, query_vec_col="qvec", query_keys_col="buckets",
                    vec_keys_col="buckets", exclude_self=exclude_self, tie_decimals=tie_decimals)


def lsh_compared_pairs(queries: DataFrame, index: LshIndex, query_vec_col: str = "embedding") -> int:
    """How many pairs an LSH search of these queries computes."""
    qb = with_buckets(queries, query_vec_col, index.dim, index.num_tables, index.bits)
    return compared_pairs(qb, index.vectors, "buckets", "buckets")


# -- A17 ----------------------------------------------------------------------

def overlap_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact top-k that the approximate top-k also returns (one row)."""
    e = exact.where(F.col("rank") <= k).select("query_id", "vec_id")
    a = approx.where(F.col("rank") <= k).select("query_id", "vec_id").withColumn("_hit", F.lit(1))
    return e.join(a, ["query_id", "vec_id"], "left").agg(
        F.avg(F.coalesce(F.col("_hit"), F.lit(0))).alias("overlap"))


def recall_by_probe(queries: DataFrame, index: IvfIndex, k: int = 10, exclude_self: bool = False,
                    tie_decimals: int | None = None) -> DataFrame:
    """``(nprobe, k, recall)`` for every probe count of an index: a search finds a true
    neighbour if it probes the neighbour's cluster, so one exact search tells all counts."""
    exact = knn_join(queries, index.vectors, k=k, metric=index.metric, exclude_self=exclude_self, tie_decimals=tie_decimals)
    order = probe_lists(queries, index, index.nlist, tie_decimals=tie_decimals).select(
        "query_id", F.posexplode("probes").alias("pos", "cluster_id"))
    need = (exact.join(index.vectors.select("vec_id", "cluster_id"), "vec_id")
            .join(order, ["query_id", "cluster_id"]).select((F.col("pos") + 1).alias("need")))
    shares = need.agg(F.array(*[F.avg((F.col("need") <= p).cast("double")) for p in range(1, index.nlist + 1)]).alias("shares"))
    return shares.select(F.posexplode("shares").alias("pos", "recall")).select(
        (F.col("pos") + 1).cast("long").alias("nprobe"), F.lit(k).alias("k"), "recall")


def compare_indexes(queries: DataFrame, vectors: DataFrame, configs: list[dict], k: int = 10,
                    exclude_self: bool = False, tie_decimals: int | None = None) -> DataFrame:
    """Per configuration ``<type>_<metric>``: overlap@k with exact search, which
    runs once per metric.

    ``configs``: dicts with ``index_type`` in flat/ivf/hnsw (hnsw is served by
    LSH here), ``metric``, and ``nlist``/``nprobe`` (or ``centroids``, a table) or
    ``num_tables``/``bits``.
    """
    out = None
    exact_by_metric = {}
    for cfg in configs:
        metric = cfg.get("metric", "l2")
        if metric not in exact_by_metric:
            exact_by_metric[metric] = materialise(
                knn_join(queries, vectors, k=k, metric=metric, exclude_self=exclude_self, tie_decimals=tie_decimals), "exact")
        exact = exact_by_metric[metric]
        kind = cfg["index_type"]
        if kind == "flat":
            got = exact
        elif kind == "ivf":
            idx = (ivf_from_centroids(vectors, cfg["centroids"], metric, tie_decimals) if "centroids" in cfg
                   else train_ivf(vectors, cfg.get("nlist", IVF_NLIST), metric))
            got = ivf_search(queries, idx, k, cfg.get("nprobe", IVF_NPROBE), exclude_self=exclude_self, tie_decimals=tie_decimals)
        elif kind == "hnsw":
            # the graph index is approximated by LSH, always L2 like the reference's
            idx = train_lsh(vectors, cfg.get("num_tables", LSH_TABLES), cfg.get("bits", LSH_BITS))
            got = lsh_search(queries, idx, k, "l2", exclude_self=exclude_self, tie_decimals=tie_decimals)
        else:
            raise ValueError(f"no such index type: {kind}")
        row = overlap_at_k(got, exact, k).select(
            F.lit(f"{kind}_{metric}").alias("config_name"), F.lit(k).alias("k"), "overlap")
        out = row if out is None else out.unionByName(row)
    return out
