"""Batch jobs (S9, S10): product CSV -> cleaned tables -> vector index."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann
from ..operators.clean import clean_products, create_metadata
from ..sources.io import materialise, save_index, write_json, write_table
from ..sources.products import load_product_csv
from .retrieval import embed_products


METADATA_SCHEMA = ", ".join(f"{c} {'bigint' if c == 'product_id' else 'string'}" for c in (
    "product_id", "image_url", "product_url", "variants_products_link", "shipping_weight", "product_dimensions",
    "product_specification", "technical_details", "is_amazon_seller", "combined_text"))


def process_data(spark: SparkSession, csv_path: str, out_dir: str, force: bool = False,
                 columns: list[str] | None = None, multi_line: bool = True) -> dict:
    """Load CSV, clean, build metadata; write cleaned table, metadata JSON and rejects.

    The input keeps a ``product_id`` column when present; otherwise one is
    derived from ``Uniq Id`` by hashing (stable across runs, no global order).
    """
    raw = load_product_csv(spark, csv_path, columns, multi_line)
    if "product_id" in raw.columns:
        raw = raw.withColumn("product_id", F.col("product_id").cast("long"))
    else:
        raw = raw.withColumn("product_id", F.xxhash64(F.col("`Uniq Id`")))
    # the CSV is parsed once; the all-null pass and all outputs read what was parsed
    cleaned = clean_products(materialise(raw, "parsed-csv"))
    path = write_table(cleaned, os.path.join(out_dir, "cleaned"), force=force)
    accepted, rejected = create_metadata(spark.read.schema(cleaned.schema).parquet(path))
    paths = {
        "cleaned": path,
        "metadata": write_json(accepted, os.path.join(out_dir, "metadata"), force=force),
        "rejected": write_table(rejected, os.path.join(out_dir, "rejected"), force=force),
    }
    return paths


def build_index(spark: SparkSession, metadata_path: str, out_dir: str, dim: int = 64,
                index_type: str = "flat", nlist: int = 100, metric: str = "l2") -> str:
    """Embed metadata texts (V1 default encoder) and save the index."""
    meta: DataFrame = spark.read.schema(METADATA_SCHEMA).json(metadata_path)
    vectors = embed_products(meta, dim)
    manifest = {"dimension": dim, "index_type": index_type, "metric": metric}
    if index_type == "ivf":
        idx = ann.train_ivf(vectors, nlist, metric)
        manifest["nlist"] = nlist
        return save_index(idx.vectors, out_dir, manifest, centroids=idx.centroids, partition_col="cluster_id",
                          metadata=meta)
    return save_index(vectors, out_dir, manifest, metadata=meta)
