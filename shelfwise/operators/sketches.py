"""Mergeable latency summaries (A6): one small row per group and day, merged on demand.

A day's durations become count, sums, extremes and a KLL quantile sketch of SKETCH_K, all of
which merge, so a new day is added without reading older ones and any span of days or
groups is summed up from the stored rows alone. A day that is written again replaces itself
(dynamic partition overwrite), so a replayed job counts nothing twice.

Quantiles have a rank error of at most RANK_ERROR (the sketch's own 99% bound is 0.7 percent
at this size; ``latency_summary`` is the exact way); everything else is exact up to float
sums. Null durations are left out; a group without any has n = 0 and no quantiles; a null
group or day is one of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_K = 400
RANK_ERROR = 0.02


def sketch_days(df: DataFrame, value_col: str, group_cols: list[str], day_col: str) -> DataFrame:
    """One row per group and day: n, total, squares, low, high, sketch."""
    v = F.col(value_col).cast("double")
    return df.groupBy(*group_cols, F.col(day_col).alias("day")).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, SKETCH_K).alias("sketch"))


def add_days(df: DataFrame, path: str, value_col: str, group_cols: list[str], day_col: str) -> None:
    """Write the rows of the days in ``df``; other days of the table stay as they are."""
    (sketch_days(df, value_col, group_cols, day_col).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def merged(days: DataFrame, group_cols: list[str], probs: list[float]) -> DataFrame:
    """Groups, n, mean, std (population), low, high and ``quantiles`` (array, in the order
    of ``probs``) over all days given. Fewer groups than were stored may be asked for."""
    held = days.groupBy(*group_cols).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("sketch"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return held.select(
        *group_cols, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.nullif("n", F.lit(0)) - mean * mean, F.lit(0.0))).alias("std"),
        "low", "high", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(
            "sketch", F.array(*[F.lit(float(p)) for p in probs]))).alias("quantiles"))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
