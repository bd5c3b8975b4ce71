"""Queries: source/sink round trips and jobs.

Each writes with the DataFrame writer into the shared checkpoint folder and
returns what Spark reads back; the oracle is SQL over the source table.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import ann, search
from ..operators.metrics import metric_rows
from ..operators.knn import knn_join
from ..sources import io, versions
from ..sources.products import PRODUCT_COLUMNS, PRODUCT_EXPRS
from ..sources.tables import read_table
from . import jobs
from .q_clean import META_COLS, META_CTE
from .q_index import CENTROID_CTE, label_centroids, probe_pairs, top_sql
from .q_search import DIM, EMB_L2, hash_sql
from .registry import products, register

CSV_COLUMNS = ["product_id"] + PRODUCT_COLUMNS + ["Upc Ean Code", "Brand Name"]
_EXPR = dict(PRODUCT_EXPRS)


def _write_product_csv(spark, sf):
    p = products(spark, sf).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in CSV_COLUMNS])
    return io.write_table(p, io.shared_folder(spark, "products-csv"), fmt="csv")


@register("io_csv_roundtrip",
          "SELECT " + ", ".join(f'CAST({_EXPR[c]} AS VARCHAR) AS "{c}"' for c in CSV_COLUMNS) + " FROM part")
def q_csv(spark, sf):
    from ..sources.products import load_product_csv
    return load_product_csv(spark, _write_product_csv(spark, sf), CSV_COLUMNS)


@register("io_index_roundtrip", "SELECT vec_id, embedding, label FROM embeddings")
def q_index_io(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    path = io.save_index(e, io.shared_folder(spark, "index"), {"dimension": DIM, "index_type": "flat"},
                         partition_col="label")
    vectors, _, _, _ = io.load_index(spark, path)
    return vectors.select("vec_id", "embedding", F.col("label").cast("int"))


@register("io_eval_roundtrip",
          "WITH ex AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS r FROM conversations u JOIN conversations a "
          "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') "
          "SELECT conv_id AS record, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, "
          "q AS query, r AS reference FROM ex")
def q_eval_io(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("r"))
    per = (u.join(a, ["conv_id", "turn"]).groupBy("conv_id")
           .agg(F.array_sort(F.collect_list(F.struct("turn", "q", "r"))).alias("x"))
           .select(F.col("conv_id").alias("record"), F.transform("x", lambda e: e["q"]).alias("queries"),
                   F.transform("x", lambda e: e["r"]).alias("references")))
    path = io.write_json(per, io.shared_folder(spark, "evalset"))
    return io.load_eval_set(spark, path)


@register("process_job", f"WITH {META_CTE} SELECT {META_COLS} FROM meta")
def q_process_job(spark, sf):
    out = io.shared_folder(spark, "process")
    paths = jobs.process_data(spark, _write_product_csv(spark, sf), out, columns=CSV_COLUMNS)
    meta = spark.read.schema(jobs.METADATA_SCHEMA).json(paths["metadata"])
    return meta.select(*[F.col(c.strip()) for c in META_COLS.split(",")])


BUILD_SQL = (
          f"WITH {META_CTE}, {hash_sql('D', 'meta', 'product_id', 'combined_text')}, "
          f"grid AS (SELECT product_id AS id, b FROM meta, range({DIM}) t(b)), "
          f"cells AS (SELECT g.id, g.b, coalesce(x.c / n.nrm, 0.0) AS v FROM grid g "
          f"LEFT JOIN D_b x ON x.id = g.id AND x.b = g.b LEFT JOIN D_n n ON n.id = g.id) "
          f"SELECT id AS vec_id, list(round(v, 6) ORDER BY b) AS embedding FROM cells GROUP BY id")


@register("build_job", BUILD_SQL)
def q_build_job(spark, sf):
    out = io.shared_folder(spark, "job")
    paths = jobs.process_data(spark, _write_product_csv(spark, sf), os.path.join(out, "data"), columns=CSV_COLUMNS)
    path = jobs.build_index(spark, paths["metadata"], os.path.join(out, "index"), dim=DIM)
    vectors, _, _, _ = io.load_index(spark, path)
    return vectors.select("vec_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@register("build_job_ivf", BUILD_SQL)
def q_build_job_ivf(spark, sf):
    """S10 with an IVF index: KMeans clusters, vectors saved partitionBy(cluster_id), centroids."""
    out = io.shared_folder(spark, "job-ivf")
    paths = jobs.process_data(spark, _write_product_csv(spark, sf), os.path.join(out, "data"), columns=CSV_COLUMNS)
    path = jobs.build_index(spark, paths["metadata"], os.path.join(out, "index"), dim=DIM, index_type="ivf", nlist=8)
    vectors, _, _, man = io.load_index(spark, path)
    if not man["is_trained"] or man.get("partition_col") != "cluster_id" or man.get("nlist") != 8:
        raise RuntimeError("IVF index must reload with its centroids and cluster partitions")
    return vectors.select("vec_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


_CENTROIDS = CENTROID_CTE.split("near AS")[0]


@register("load_and_search",
          f"WITH base AS (SELECT * FROM embeddings), {_CENTROIDS} "
          "grown AS (SELECT vec_id, embedding, label FROM base UNION ALL "
          "SELECT vec_id + 1000000000, list_reverse(embedding), label FROM base), "
          "near AS (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY vec_id "
          "ORDER BY round(pow(list_distance(CAST(embedding AS DOUBLE[]), c), 2), 9), cluster_id) AS r FROM grown, cents), "
          f"d AS (SELECT p.q AS query_id, b.vec_id, {EMB_L2} AS dist FROM ({probe_pairs(2)} AND n.vec_id < 1000000000) p "
          "JOIN grown a ON a.vec_id = p.q JOIN grown b ON b.vec_id = p.v) "
          "SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(dist, 6) AS dist FROM (SELECT *, row_number() "
          "OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= 5")
def q_load_and_search(spark, sf):
    """Build and save an IVF index, load it, add vectors with the checks of an add,
    save and load again, and search only the partitions that are probed."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    index = ann.ivf_from_centroids(e.select("vec_id", "embedding"), label_centroids(e), tie_decimals=9)

    def stored(idx):
        path = io.save_index(idx.vectors, io.shared_folder(spark, "ivf"), {"index_type": "ivf", "metric": "l2"},
                             centroids=idx.centroids, partition_col="cluster_id")
        return ann.load_ivf(spark, path)
    loaded = stored(index)
    extra = e.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.reverse("embedding").alias("embedding"))
    search.check_add(extra, extra.select("vec_id"), DIM)
    grown = stored(ann.ivf_add(loaded, extra))
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = ann.ivf_search(q, grown, k=5, nprobe=2, tie_decimals=9, prune=True)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("dist"))


@register("io_metrics_roundtrip",
          "SELECT 'index_stats' AS section, 'total_vectors' AS metric, CAST(count(*) AS DOUBLE) AS value FROM embeddings "
          "UNION ALL SELECT 'index_stats', 'dimension', CAST(max(len(embedding)) AS DOUBLE) FROM embeddings "
          "UNION ALL SELECT 'index_stats', 'memory_usage_mb', round(count(*) * max(len(embedding)) * 4 / (1024.0 * 1024.0), 6) FROM embeddings")
def q_metrics_io(spark, sf):
    """Metric rows written as JSON lines and read back."""
    stats = search.index_stats(read_table(spark, sf, "embeddings", ["vec_id", "embedding"]))
    rows = metric_rows(stats, "index_stats", ["total_vectors", "dimension", "memory_usage_mb"])
    path = io.write_json(rows, io.shared_folder(spark, "metrics"))
    back = spark.read.schema("section string, metric string, value double").json(path)
    return back.select("section", "metric", F.round("value", 6).alias("value"))


# A versioned index: half of the labels first (1), the others added (2), label 0 taken out (3)
# and put back (4), label 9 taken out (5), compacted (6).
_VERSION_ROWS = {1: "coalesce(label < 5, false)", 2: "true", 3: "coalesce(label <> 0, true)", 4: "true",
                 5: "coalesce(label <> 9, true)", 6: "coalesce(label <> 9, true)"}


def _versioned_index(spark, sf, upto: int) -> str:
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    path = io.shared_folder(spark, "versioned-index")
    steps = [lambda: versions.create(e.where("coalesce(label < 5, false)"), path),
             lambda: versions.add(e.where("NOT coalesce(label < 5, false)"), path),
             lambda: versions.remove(e.where("label = 0"), path), lambda: versions.add(e.where("label = 0"), path),
             lambda: versions.remove(e.where("label = 9"), path), lambda: versions.compact(spark, path)]
    for step in steps[:upto]:
        step()
    return path


@register("index_versions", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT CAST({v} AS INTEGER) AS version, count(*) AS total_vectors, coalesce(CAST(sum(vec_id) AS BIGINT), 0) AS id_sum, "
    f"CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings WHERE {rows}" for v, rows in _VERSION_ROWS.items()) + ")")
def q_index_versions(spark, sf):
    path = _versioned_index(spark, sf, 6)
    out = None
    for v in versions.versions(spark, path):
        row = versions.read(spark, path, v).agg(
            F.lit(v).alias("version"), F.count(F.lit(1)).alias("total_vectors"),
            F.coalesce(F.sum("vec_id"), F.lit(0).cast("bigint")).alias("id_sum"), F.max(F.size("embedding")).alias("dimension"))
        out = row if out is None else out.unionByName(row)
    return out


@register("index_search_at_version", "SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, label, round(dist, 6) AS dist FROM (" + top_sql(
    "SELECT a.vec_id AS q, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id "
    "AND coalesce(b.label <> 0, true)", EMB_L2, 5) + ")")
def q_index_search_at_version(spark, sf):
    path = _versioned_index(spark, sf, 4)   # version 3 is no longer the latest
    index = versions.read(spark, path, 3)
    queries = read_table(spark, sf, "embeddings", ["vec_id", "embedding"]).withColumnRenamed("vec_id", "query_id")
    hits = knn_join(queries, index, k=5, exclude_self=True, tie_decimals=9)
    return (hits.join(index.select("vec_id", "label"), "vec_id")
            .select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "label", F.round("score", 6).alias("dist")))
