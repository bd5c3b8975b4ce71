"""Registered queries: a Spark plan and (where SQL can say it) a DuckDB oracle.

Every query reads whole driver tables (or data Spark derives from them); no id
subsets, row caps or prefixes. Doubles are rounded to 6 places and integer
counts are BIGINT on both sides so value hashes compare.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.products import product_frame, product_sql
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_frame(read_table(spark, sf_dir, "part"))


PRODUCTS_CTE = f"products AS (\n{product_sql('part')}\n)"


def load_all() -> None:
    """Import every query module (each registers on import)."""
    for mod in ("q_clean", "q_search", "q_extract", "q_vectors", "q_prompts", "q_metrics", "q_index", "q_io"):
        importlib.import_module(f"{__package__}.{mod}")
