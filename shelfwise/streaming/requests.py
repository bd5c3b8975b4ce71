"""Search requests as a stream (the batch-search endpoint, re-aimed).

Request files (JSON lines ``query_id, text_query, k, rerank``) land in a
folder; a Structured Streaming query picks them up and ``foreachBatch`` runs
the batch retrieval plan (validation, kNN, rerank, error rows) against the
index. Each micro-batch writes its own output folder with ``overwrite``, so a
batch replayed after a failure (same ``batch_id``, from the checkpoint) replaces
its earlier partial output: the sink is idempotent and the results are
exactly-once. The query's checkpoint lives in the shared checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.retrieval import batch_retrieve
from ..sources.io import shared_folder

REQUEST_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("text_query", T.StringType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("rerank", T.BooleanType()),
])


def start_request_stream(spark: SparkSession, requests_dir: str, index: DataFrame, metadata: DataFrame,
                         output_dir: str, checkpoint_dir: str | None = None, dim: int = 64,
                         available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the streaming query; returns the ``StreamingQuery``.

    ``available_now`` processes what is there and stops (batch-style
    back-fill); otherwise the query keeps running on new files.
    """
    checkpoint_dir = checkpoint_dir or shared_folder(spark, "request-stream-ckpt")
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(requests_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        out = batch_retrieve(batch, index, metadata, dim=dim).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").parquet(os.path.join(output_dir, f"batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_stream_output(spark: SparkSession, output_dir: str) -> DataFrame:
    """All results written so far (the batch folders read as one table)."""
    return spark.read.parquet(output_dir)
