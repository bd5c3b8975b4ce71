"""Helpers shared by the operators: tables, the shared folder, files written from tasks."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session, so that rows with long
    texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; read by Spark only, so any store Spark knows will do."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    ship_package(spark)
    bounded_batches(spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, row_group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends in
    files every executor sees, and what follows never runs ``df`` again. A task's
    writer holds a row group, ``row_group_bytes`` if given."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    schema = df.schema
    size = {} if row_group_bytes is None else {"parquet.block.size": str(row_group_bytes)}
    df.write.options(**size).parquet(path)
    return spark.read.schema(schema).parquet(path)


@functools.cache
def _filesystem(base: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(base)


def put_file(base: str, name: str, data: bytes) -> None:
    """Write one whole file ``base/name`` from a task. ``name`` must be unique to
    the task attempt: a retried task writes another file and only the attempt
    whose rows Spark keeps is ever referred to."""
    fs_, root = _filesystem(base)
    fs_.create_dir(root, recursive=True)
    with fs_.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(data)


def open_file(base: str, name: str):
    """Random-access reader of ``base/name``."""
    fs_, root = _filesystem(base)
    return fs_.open_input_file(f"{root}/{name}")


def put_stream(base: str, name: str):
    """Output stream for ``base/name`` (same naming rule as :func:`put_file`)."""
    fs_, root = _filesystem(base)
    fs_.create_dir(root, recursive=True)
    return fs_.open_output_stream(f"{root}/{name}", compression=None)
