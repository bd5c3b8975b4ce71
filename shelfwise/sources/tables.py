"""Reading the driver tables (one Parquet file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core.

    A table stored as one small file (one row group) scans as a single task,
    so every per-row operator after it runs single-threaded. Large inputs
    already have one split per block and are returned untouched; only inputs
    with fewer partitions than the cluster's parallelism pay one small
    round-robin shuffle.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def as_large(df: DataFrame) -> DataFrame:
    """A join side that grows with the data: met by sort-merge, never broadcast.

    Sizes are estimated from the files, and a small compressed file says little of the
    rows made from it (positions of texts, vectors, texts put together), so an estimate
    below the broadcast threshold may hold gigabytes that would pass through the driver.
    """
    return df.hint("merge")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               spread_small: bool = True) -> DataFrame:
    """Read one table; selecting ``columns`` here keeps the scan's ReadSchema narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    return spread(df) if spread_small else df
