"""Sinks and table round trips.

Everything is written with the DataFrame writer into a folder the cluster
shares (by default under ``spark.checkpoint.dir``), never a machine-local temp
folder. ``force`` maps the reference's overwrite flag to the save mode.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


FILES_PER_PARTITION = 8


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "shelfwise", f"{name}-{uuid.uuid4().hex[:12]}")


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", force: bool = False,
                partition_by: list[str] | None = None) -> str:
    """Write a table (Parquet by default, CSV with a header)."""
    w = df.write.mode(_mode(force))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_json(df: DataFrame, path: str, force: bool = False) -> str:
    """JSON lines, one record per row."""
    df.write.mode(_mode(force)).json(path)
    return path


# -- S5, S6 -------------------------------------------------------------------

def save_index(vectors: DataFrame, path: str, manifest: dict, centroids: DataFrame | None = None,
               partition_col: str | None = None, metadata: DataFrame | None = None, force: bool = True) -> str:
    """Vector table (partitioned by cluster for IVF), centroids, metadata, manifest.

    A partitioned table is first dealt out by cluster and salt, so a cluster has
    FILES_PER_PARTITION files at most and a hot one is written by several tasks. The
    manifest keeps the number of vectors, their dimension and the number of centroids.
    """
    if partition_col:
        salt = F.pmod(F.xxhash64("vec_id"), F.lit(FILES_PER_PARTITION))
        vectors = vectors.repartition(F.col(partition_col), salt)
    write_table(vectors, os.path.join(path, "vectors"), force=force,
                partition_by=[partition_col] if partition_col else None)
    if centroids is not None:
        write_table(centroids, os.path.join(path, "centroids"), force=force)
    if metadata is not None:
        write_table(metadata, os.path.join(path, "metadata"), force=force)
    spark = vectors.sparkSession
    saved = spark.read.parquet(os.path.join(path, "vectors")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    man = dict(manifest, total_vectors=saved["n"], vector_dimension=saved["dim"],
               n_centroids=centroids.count() if centroids is not None else 0, partition_col=partition_col, has_centroids=centroids is not None,
               has_metadata=metadata is not None)
    spark.createDataFrame([(json.dumps(man),)], "manifest string").coalesce(1) \
        .write.mode(_mode(force)).text(os.path.join(path, "manifest"))
    return path


def load_index(spark: SparkSession, path: str):
    """(vectors, centroids or None, metadata or None, manifest dict).

    What is read must agree with the manifest: number and dimension of the vectors,
    number of centroids; otherwise ``ValueError``. An index that needs no training, or
    has its centroids, is trained.
    """
    man = json.loads(spark.read.text(os.path.join(path, "manifest")).first()[0])
    vectors = spark.read.parquet(os.path.join(path, "vectors"))
    centroids = spark.read.parquet(os.path.join(path, "centroids")) if man.get("has_centroids") else None
    meta = spark.read.parquet(os.path.join(path, "metadata")) if man.get("has_metadata") else None
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"),
                        F.max(F.size("embedding")).alias("high")).first()
    if found["n"] != man["total_vectors"]:
        raise ValueError(f"the index has {found['n']} vectors where its manifest has {man['total_vectors']}")
    if found["n"] and {found["low"], found["high"]} != {man["vector_dimension"]}:
        raise ValueError(f"vectors of dimension {found['low']} to {found['high']}, manifest {man['vector_dimension']}")
    n_centroids = centroids.count() if centroids is not None else 0
    if n_centroids != man["n_centroids"]:
        raise ValueError(f"the index has {n_centroids} centroids where its manifest has {man['n_centroids']}")
    man["is_trained"] = man.get("index_type") != "ivf" or n_centroids > 0
    return vectors, centroids, meta, man


# -- S7 -----------------------------------------------------------------------

def load_eval_set(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Records ``{"queries": [...], "references": [...]}`` -> ``(record, pos, query, reference)``.

    ``multi_line`` reads one pretty-printed document per file (the reference's
    layout); the default reads JSON lines (one record per line, splittable).
    """
    df = spark.read.option("multiLine", multi_line).schema(
        "record long, queries array<string>, references array<string>").json(path)
    z = F.arrays_zip(F.col("queries").alias("query"), F.col("references").alias("reference"))
    return (df.select(F.coalesce("record", F.lit(0)).alias("record"), F.posexplode(z).alias("pos", "x"))
            .select("record", F.col("pos").cast("long").alias("pos"),
                    F.col("x.query").alias("query"), F.col("x.reference").alias("reference")))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so several readers
    share one computation and lost executors never repeat it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
