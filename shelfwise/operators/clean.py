"""Cleaning, validation and splitting of product tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (BAD_IMAGE_MARKER, DROP_COLUMNS, FILL_COLUMNS, K_MAX, K_MIN,
                         MIN_TRAIN_TEXT_CHARS, NOT_AVAILABLE, TEXT_FIELDS, TEXT_SEPARATOR,
                         TRAIN_RATIO)
from ..functions.text import strip
from ..sources.io import materialise


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# -- C1-C3, C6 ---------------------------------------------------------------

def all_null_columns(df: DataFrame) -> list[str]:
    """Columns null in every row: one aggregate pass (count skips nulls)."""
    counts = df.agg(*[F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if counts[f"c{i}"] == 0]


def drop_empty_columns(df: DataFrame, keep: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Drop columns that hold no value at all."""
    return df.drop(*[c for c in all_null_columns(df) if c not in keep])


def drop_named_columns(df: DataFrame, names: list[str] = DROP_COLUMNS) -> DataFrame:
    """Drop listed columns when present."""
    return df.drop(*[n for n in names if n in df.columns])


def fill_not_available(df: DataFrame, columns: list[str] = FILL_COLUMNS) -> DataFrame:
    """Fill nulls of the listed (present) columns with the null marker."""
    present = {c: NOT_AVAILABLE for c in columns if c in df.columns}
    return df.fillna(present) if present else df


def clean_products(df: DataFrame, drop_empty: bool = True) -> DataFrame:
    """C1 + C2 + C3. ``drop_empty`` costs one aggregate job (data-dependent schema)."""
    if drop_empty:
        df = drop_empty_columns(df)
    return fill_not_available(drop_named_columns(df))


# -- C4, C5, C7 --------------------------------------------------------------

def _value_or_absent(df: DataFrame, name: str) -> Column:
    """A column value, or null when the column is missing (dropped as empty)."""
    return _q(name) if name in df.columns else F.lit(None).cast("string")


def combined_text(df: DataFrame) -> Column:
    """C4: ``Product Name: x | Category: y | Price: z | Model: m | About: a``.

    Parts whose value is the null marker (or absent) are skipped.
    """
    parts = []
    for i, (label, col) in enumerate(TEXT_FIELDS):
        v = _value_or_absent(df, col)
        part = F.concat(F.lit(f"{label}: "), v)
        parts.append(part if i == 0 else F.when(v != NOT_AVAILABLE, part))
    return F.concat_ws(TEXT_SEPARATOR, *parts)


URL_PATTERN = r"^https?://[^/?#\s:@]+(:[0-9]+)?([/?#]\S*)?$"


def url_is_valid(c) -> Column:
    """Absolute http(s) URL with a host."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.rlike(URL_PATTERN), F.lit(False))


def with_metadata(df: DataFrame) -> DataFrame:
    """C5 projection plus ``reject_reason`` (null for accepted rows)."""
    reason = (
        F.when(_value_or_absent(df, "Product Name").isNull(), F.lit("missing product name"))
        .when(_value_or_absent(df, "Image").isNull(), F.lit("missing image_url"))
        .when(_value_or_absent(df, "Is Amazon Seller").isNull(), F.lit("missing is_amazon_seller"))
        .when(~url_is_valid(_value_or_absent(df, "Product Url")), F.lit("invalid product_url"))
    )
    na = F.lit(NOT_AVAILABLE)
    return df.select(
        F.col("product_id"),
        _value_or_absent(df, "Image").alias("image_url"),
        _value_or_absent(df, "Product Url").alias("product_url"),
        F.coalesce(_value_or_absent(df, "Variants"), na).alias("variants_products_link"),
        F.coalesce(_value_or_absent(df, "Shipping Weight"), na).alias("shipping_weight"),
        F.coalesce(_value_or_absent(df, "Product Dimensions"), na).alias("product_dimensions"),
        F.coalesce(_value_or_absent(df, "Product Specification"), na).alias("product_specification"),
        F.coalesce(_value_or_absent(df, "Technical Details"), na).alias("technical_details"),
        _value_or_absent(df, "Is Amazon Seller").alias("is_amazon_seller"),
        combined_text(df).alias("combined_text"),
        reason.alias("reject_reason"),
    )


def create_metadata(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted metadata, quarantined rows with a reason). Both lazy."""
    m = with_metadata(df)
    accepted = m.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = m.where(F.col("reject_reason").isNotNull()).select("product_id", "reject_reason")
    return accepted, rejected


def process_products(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned table, accepted metadata, rejects."""
    cleaned = clean_products(df)
    accepted, rejected = create_metadata(cleaned)
    return cleaned, accepted, rejected


# -- C8 ----------------------------------------------------------------------

def quality_report(vectors: DataFrame, dim: int, required: list[str],
                   vec_col: str = "embedding") -> DataFrame:
    """One row of rule counts for a vector table (a single aggregate pass)."""
    missing = [c for c in required if c not in vectors.columns]
    v = F.col(vec_col)
    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).cast("long").alias("n_null"),
        F.sum(F.when(v.isNotNull() & (F.size(v) != dim), 1).otherwise(0)).cast("long").alias("n_wrong_dim"),
        F.sum(F.when(F.exists(v, lambda x: F.isnan(x)), 1).otherwise(0)).cast("long").alias("n_nan"),
        F.lit(len(missing)).cast("long").alias("n_missing_columns"),
    )


# -- C9-C11 ------------------------------------------------------------------

def first_url(c) -> Column:
    """First URL of a ``|``-separated list, stripped."""
    col = F.col(c) if isinstance(c, str) else c
    return strip(F.element_at(F.split(col, r"\|"), 1))


def all_urls(df: DataFrame, id_col: str, c: str) -> DataFrame:
    """One row per listed URL: ``(id, pos, url)``."""
    return (df.select(id_col, F.posexplode(F.split(F.col(c), r"\|")).alias("pos", "url"))
            .select(id_col, F.col("pos").cast("int"), strip("url").alias("url")))


def training_rows(meta: DataFrame) -> DataFrame:
    """Rows usable for training (text > 10 chars, usable first image URL)."""
    first = first_url("image_url")
    return meta.where(
        F.col("combined_text").isNotNull()
        & (F.length(strip("combined_text")) > MIN_TRAIN_TEXT_CHARS)
        & F.col("image_url").isNotNull() & (F.col("image_url") != "")
        & (first != "")
        & ~F.lower(first).contains(BAD_IMAGE_MARKER)
    )


def global_position(df: DataFrame, key: str, n_parts: int | None = None) -> DataFrame:
    """Exact 0-based position of each row in ``key`` order, without one-task windows.

    Range-partition by key, write the ranges once (with their number), count rows
    per range (a tiny table: one row per range), turn the counts into offsets, and
    add the row number inside the range. Both branches read the written table, so
    positions never hang on a shuffle being run, or reused, the same way twice. No
    task holds more than its range.
    """
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n_parts, F.col(key)).withColumn("_pid", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(F.col(key))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn("position", F.col("_off") + F.row_number().over(w) - 1)
            .drop("_pid", "_off"))


def positional_split(df: DataFrame, key: str, ratio: float = TRAIN_RATIO) -> DataFrame:
    """C11: first ``int(n * ratio)`` rows in key order are ``train``, the rest ``validation``."""
    n = df.count()
    cut = int(n * ratio)
    return (global_position(df, key)
            .withColumn("split", F.when(F.col("position") < cut, "train").otherwise("validation")))


def hash_split(df: DataFrame, key: str, ratio: float = TRAIN_RATIO) -> DataFrame:
    """C11 scale variant: stable split by key hash (no count, no ordering)."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(10_000))
    return df.withColumn("split", F.when(bucket < int(ratio * 10_000), "train").otherwise("validation"))


# -- C15 ---------------------------------------------------------------------

def validate_requests(requests: DataFrame, text_col: str = "text_query",
                      image_col: str | None = "image_query", k_col: str = "k") -> DataFrame:
    """Adds ``reject_reason`` (null = valid).

    A request needs a text or an image (a non-empty string, or a vector), and
    ``1 <= k <= 50``. A table is the batch, so the number of requests is no reason.
    """
    has_image = F.lit(False)
    if image_col and image_col in requests.columns:
        vector = dict(requests.dtypes)[image_col].startswith("array")
        has_image = F.col(image_col).isNotNull() & ((F.size(image_col) > 0) if vector else (F.col(image_col) != ""))
    has_text = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    k = F.col(k_col)
    reason = (F.when(~has_text & ~has_image, F.lit("no text or image query"))
              .when(k.isNull() | (k < K_MIN) | (k > K_MAX), F.lit(f"k must be in {K_MIN}..{K_MAX}")))
    return requests.withColumn("reject_reason", reason)
