"""Vector-table operations around the kNN join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import NO_RESULTS_MESSAGE
from ..functions.text import overlap, token_set
from ..sources.tables import as_large
from .knn import knn_join


# -- N6, U1, U3, J4/N7, A1 ----------------------------------------------------

def check_add(vectors: DataFrame, metadata: DataFrame, dim: int, id_col: str = "vec_id",
              vec_col: str = "embedding") -> None:
    """N6 checks before an append: every vector has metadata (and back), right dimension.

    One full-outer-join count and one aggregate; raises ``ValueError`` like the
    reference's count and dimension checks.
    """
    unmatched = (vectors.select(id_col).withColumn("_v", F.lit(1))
                 .join(metadata.select(id_col).withColumn("_m", F.lit(1)), id_col, "full_outer")
                 .where(F.col("_v").isNull() | F.col("_m").isNull()).limit(1).count())
    if unmatched:
        raise ValueError("Number of embeddings must match number of metadata entries")
    bad = vectors.where(F.size(vec_col) != dim).limit(1).count()
    if bad:
        raise ValueError(f"Embedding dimension doesn't match index dimension {dim}")


def add_vectors(index: DataFrame, vectors: DataFrame, vec_col: str = "embedding", metadata: DataFrame | None = None,
                id_col: str = "vec_id") -> DataFrame:
    """Append rows (cast to float32 arrays like the index) after the checks of
    an add: the index's dimension and, with ``metadata``, a record for every vector."""
    dim = index.agg(F.max(F.size(vec_col))).first()[0]
    if dim is None:
        dim = vectors.agg(F.max(F.size(vec_col))).first()[0] or 0
    check_add(vectors, vectors if metadata is None else metadata, dim, id_col, vec_col)
    return index.unionByName(vectors.withColumn(vec_col, F.col(vec_col).cast("array<float>")))


def remove_vectors(index: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Drop vectors whose id is listed; ids of survivors stay stable."""
    return index.join(ids.select(id_col).distinct(), id_col, "left_anti")


def clear(index: DataFrame) -> DataFrame:
    """Empty table of the same schema."""
    return index.limit(0)


def index_stats(index: DataFrame, index_type: str = "flat", vec_col: str = "embedding") -> DataFrame:
    """A1: total vectors, dimension, type, estimated MB (n * dim * 4 / 2^20)."""
    return index.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.max(F.size(vec_col)).alias("dimension"),
    ).select(
        "total_vectors", "dimension", F.lit(index_type).alias("index_type"),
        (F.col("total_vectors") * F.col("dimension") * 4 / (1024.0 * 1024.0)).alias("memory_usage_mb"))


# -- J1, J6 -------------------------------------------------------------------

def attach(hits: DataFrame, metadata: DataFrame, id_col: str = "vec_id",
           meta_id_col: str = "vec_id") -> DataFrame:
    """Hit -> metadata by id; hits without metadata drop (inner join)."""
    m = metadata if meta_id_col == id_col else metadata.withColumnRenamed(meta_id_col, id_col)
    return hits.join(as_large(m), id_col)


def with_no_result_rows(queries: DataFrame, hits: DataFrame, query_id_col: str = "query_id") -> DataFrame:
    """Keep queries without hits as one row carrying the fixed message."""
    q = queries.select(F.col(query_id_col).alias("query_id")).distinct()
    return (q.join(hits, "query_id", "left")
            .withColumn("message", F.when(F.col("rank").isNull(), F.lit(NO_RESULTS_MESSAGE))))


# -- X3 -----------------------------------------------------------------------

def rerank_by_overlap(hits: DataFrame, query_text_col: str = "text_query",
                      item_text_col: str = "combined_text") -> DataFrame:
    """Order each query's hits by token overlap with the query, stable on ties.

    Keeps ``orig_rank`` and ``orig_score``; ``score`` becomes 0.0 as in the
    reference. The window is per query (k rows), never global.
    """
    scored = (hits.withColumn("overlap", overlap(token_set(query_text_col), token_set(item_text_col)))
              .withColumnRenamed("rank", "orig_rank").withColumnRenamed("score", "orig_score"))
    w = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), F.col("orig_rank").asc())
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("score", F.lit(0.0))


# -- N9 -----------------------------------------------------------------------

def similar_items(vectors: DataFrame, k: int = 5, metric: str = "l2", id_col: str = "vec_id",
                  vec_col: str = "embedding", url_col: str | None = None, **kw) -> DataFrame:
    """K nearest other items of every item. An item itself is left out before
    ranking: by id, or with ``url_col`` every item of the same URL (items without a
    URL by id)."""
    own = F.col(id_col).cast("long")
    if url_col:
        own = F.when(F.col(url_col).isNull(), own).otherwise(F.xxhash64(url_col))
    v = vectors.withColumn("_own", own)
    q = v.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("qvec"), "_own")
    return knn_join(q, v, k=k, metric=metric, query_vec_col="qvec", vec_id_col=id_col, vec_col=vec_col, exclude_self=True,
                    query_own_col="_own", vec_own_col="_own", **kw)
