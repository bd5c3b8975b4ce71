"""Retrieval plan (N10, N11): queries -> vectors -> kNN -> metadata -> rerank.

Queries are a table, so one query and a million use the same plan. Requests
failing validation become error rows instead of failing the job (N11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_QUERY_TEXT
from ..functions.vectors import hash_embed
from ..operators.clean import validate_requests
from ..operators.knn import knn_join
from ..operators.search import attach, rerank_by_overlap, with_no_result_rows


def embed_products(meta: DataFrame, dim: int = 64, text_col: str = "combined_text",
                   encoder=None, id_col: str = "product_id") -> DataFrame:
    """Product vectors for the index.

    Default encoder: hashed bag of words (JVM buckets + Arrow histogram).
    ``encoder``: a caller's batch function ``list[str] -> array (n, dim)`` (a
    model), run over Arrow batches with ``mapInPandas`` so the model loads
    once per Python worker and sees whole batches.
    """
    if encoder is None:
        return meta.select(F.col(id_col).alias("vec_id"), hash_embed(text_col, dim).alias("embedding"))

    def run(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            vecs = np.asarray(encoder(pdf["t"].fillna("").tolist()), dtype=np.float32)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("int64"), "embedding": list(vecs)})

    return (meta.select(F.col(id_col).cast("long").alias("vec_id"), F.col(text_col).alias("t"))
            .mapInPandas(run, "vec_id long, embedding array<float>"))


def request_vector(dim: int, image_vec_col: str | None = None, fusion: str = "average") -> Column:
    """Query vector of a request: its text's, its image's (a vector column), or both
    averaged component by component, or one after the other (``concatenate``)."""
    text = hash_embed("text_query", dim)
    if image_vec_col is None:
        return text
    if fusion not in ("average", "concatenate"):
        raise ValueError(f"no such fusion of text and image: {fusion}")
    image = F.col(image_vec_col).cast("array<double>")
    both = (F.zip_with(text, image, lambda a, b: (a + b) / 2) if fusion == "average" else F.concat(text, image))
    has_text, has_image = F.coalesce(F.col("text_query"), F.lit("")) != "", F.coalesce(F.size(image), F.lit(0)) > 0
    return F.when(has_text & has_image, both).when(has_image, image).otherwise(text)


def question_text(text_col: str = "text_query") -> Column:
    """What an answer is asked for: the request's text, or the default question of an
    image without one."""
    return F.when(F.coalesce(F.col(text_col), F.lit("")) != "", F.col(text_col)).otherwise(F.lit(DEFAULT_QUERY_TEXT))


def retrieve(requests: DataFrame, index: DataFrame, metadata: DataFrame, k: int = 5,
             dim: int = 64, metric: str = "l2", k_col: str | None = None,
             rerank: bool = False, tie_decimals: int | None = 9, image_vec_col: str | None = None,
             fusion: str = "average") -> DataFrame:
    """N10 without generation: ranked hits joined to metadata, optional rerank.

    ``requests``: ``(query_id, text_query[, k][, image vector])``; ``index``:
    ``(vec_id, embedding)``; ``metadata``: ``(product_id, combined_text, ...)``.
    Requests without a text keep their order in a rerank: no token overlaps.
    """
    q = requests.select("query_id", "text_query", *([k_col] if k_col else []),
                        request_vector(dim, image_vec_col, fusion).alias("qvec"))
    hits = knn_join(q, index, k=k, metric=metric, query_vec_col="qvec", k_col=k_col,
                    tie_decimals=tie_decimals)
    hits = attach(hits, metadata.withColumnRenamed("product_id", "vec_id"))
    hits = hits.join(requests.select("query_id", "text_query"), "query_id")
    if rerank:
        hits = rerank_by_overlap(hits)
    return hits.withColumnRenamed("vec_id", "product_id")


def batch_retrieve(requests: DataFrame, index: DataFrame, metadata: DataFrame, dim: int = 64,
                   rerank_col: str | None = "rerank", image_vec_col: str | None = None) -> DataFrame:
    """Validate, retrieve valid requests with their own k, error rows for the rest.

    Output: ``(query_id, rank, product_id, score, message)``; a rejected request
    is one row with null rank and ``Error processing query: <reason>``.
    """
    checked = validate_requests(requests, image_col=image_vec_col)
    valid = checked.where(F.col("reject_reason").isNull())
    bad = checked.where(F.col("reject_reason").isNotNull())
    hits = retrieve(valid, index, metadata, dim=dim, k_col="k", image_vec_col=image_vec_col)
    if rerank_col and rerank_col in requests.columns:
        rr = rerank_by_overlap(hits.withColumnRenamed("product_id", "vec_id")) \
            .withColumnRenamed("vec_id", "product_id")
        flags = valid.select("query_id", F.col(rerank_col).alias("_rr"))
        hits = rr.join(flags, "query_id").select(
            "query_id", F.when(F.col("_rr"), F.col("rank")).otherwise(F.col("orig_rank")).alias("rank"),
            "product_id",
            F.when(F.col("_rr"), F.col("score")).otherwise(F.col("orig_score")).alias("score"))
    else:
        hits = hits.select("query_id", "rank", "product_id", "score")
    found = with_no_result_rows(valid, hits.withColumnRenamed("product_id", "vec_id")) \
        .withColumnRenamed("vec_id", "product_id")
    errors = bad.select("query_id", F.lit(None).cast("int").alias("rank"),
                        F.lit(None).cast("long").alias("product_id"),
                        F.lit(None).cast("double").alias("score"),
                        F.concat(F.lit("Error processing query: "), F.col("reject_reason")).alias("message"))
    return found.select("query_id", "rank", "product_id", "score", "message").unionByName(errors)
