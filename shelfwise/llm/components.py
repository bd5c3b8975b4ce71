"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _neighbours(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a")


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges (a, b)``.

    Large and small stars alternate until nothing changes; the rounds grow with the
    logarithm of a component's size. Minima are aggregated before the shuffle and the
    joins are plain sort-merge joins, so a node with very many edges can be split.
    Each round is written to the shared folder. No edges: an empty table.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        large = _neighbours(edges).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        small = (small.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*"))
        edges = written(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionAll(edges.select(F.col("b"), F.col("b")).distinct()))
