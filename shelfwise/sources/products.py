"""Product tables: CSV loading (S1) and the product view over ``part``.

The reference reads a product CSV whose 14+ columns are all text. The driver
tables hold no such file, so ``product_frame`` derives one from ``part`` with
plain SQL expressions. The same expressions are rendered for DuckDB by the
oracle, so both engines see identical products (nulls, bad URLs and rejected
rows included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CSV_NULL_TOKENS

# Product CSV columns of the reference fixture, in file order.
PRODUCT_COLUMNS = [
    "Uniq Id", "Product Name", "Category", "Selling Price", "Model Number",
    "About Product", "Product Specification", "Technical Details",
    "Shipping Weight", "Product Dimensions", "Image", "Variants",
    "Product Url", "Is Amazon Seller",
]

_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"
_PRICE = (f"'$' || CAST(CAST(floor({_CENTS} / 100) AS BIGINT) AS STRING) || '.' || "
          f"lpad(CAST({_CENTS} % 100 AS STRING), 2, '0')")
_DIMS = ("CAST(p_size AS STRING) || ' x ' || CAST(p_partkey % 7 + 1 AS STRING) || ' x ' || "
         "CAST(p_partkey % 5 + 2 AS STRING) || ' inches'")
_WEIGHT = ("CAST(p_size % 9 + 1 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || ' pounds'")
_MATERIAL = ("CASE p_size % 4 WHEN 0 THEN 'steel' WHEN 1 THEN 'plastic' "
             "WHEN 2 THEN 'wood' ELSE 'cotton' END")

# (column name, SQL expression over part) -- valid in Spark SQL and DuckDB.
PRODUCT_EXPRS: list[tuple[str, str]] = [
    ("product_id", "p_partkey"),
    ("Uniq Id", "'u' || CAST(p_partkey AS STRING)"),
    ("Product Name", "p_name"),
    ("Category", "CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE p_type END"),
    ("Selling Price", f"CASE WHEN p_partkey % 10 = 7 THEN NULL ELSE {_PRICE} END"),
    ("Model Number", "CASE WHEN p_partkey % 8 = 3 THEN NULL ELSE "
                     "'MDL-' || CAST(p_size AS STRING) || '-' || CAST(p_partkey AS STRING) END"),
    ("About Product", "CASE WHEN p_partkey % 12 = 5 THEN NULL ELSE "
                      "'Made by ' || p_brand || ', a ' || p_name || ' of size ' || CAST(p_size AS STRING) END"),
    ("Product Specification", f"CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE "
                              f"'Product Dimensions: ' || {_DIMS} || ' | Item Weight: ' || {_WEIGHT} || "
                              f"' | ASIN: B0' || lpad(CAST(p_partkey AS STRING), 8, '0') END"),
    ("Technical Details", f"CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE "
                          f"'Color: ' || split_part(p_name, ' ', 1) || ' | Material: ' || {_MATERIAL} || "
                          f"' | Batteries: ' || CAST(p_size % 4 AS STRING) || ' AA batteries required"
                          f" | Rating: ' || CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || "
                          f"' out of 5 stars | Manufacturer Recommended Age: ' || CAST(p_size % 12 + 1 AS STRING) || "
                          f"' years and up | Domestic Shipping: ships in ' || CAST(p_partkey % 7 + 1 AS STRING) || "
                          f"' days' END"),
    ("Shipping Weight", f"CASE WHEN p_partkey % 7 = 6 THEN NULL ELSE {_WEIGHT} END"),
    ("Product Dimensions", f"CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE {_DIMS} END"),
    ("Image", "CASE WHEN p_partkey % 17 = 16 THEN NULL "
              "WHEN p_partkey % 15 = 0 THEN 'https://img.example.com/transparent-pixel.gif|"
              "https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg' "
              "ELSE 'https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg|"
              "https://img.example.com/' || CAST(p_partkey AS STRING) || '-b.jpg' END"),
    ("Variants", "CASE WHEN p_partkey % 20 = 0 THEN 'https://shop.example.com/v/' || "
                 "CAST(p_partkey AS STRING) ELSE NULL END"),
    ("Upc Ean Code", "'0' || lpad(CAST(p_partkey AS STRING), 11, '0')"),
    ("Brand Name", "CAST(NULL AS STRING)"),
    ("Product Url", "CASE WHEN p_partkey % 19 = 11 THEN 'shop.example.com/p/' || CAST(p_partkey AS STRING) "
                    "ELSE 'https://shop.example.com/p/' || CAST(p_partkey AS STRING) END"),
    ("Is Amazon Seller", "CASE WHEN p_partkey % 23 = 22 THEN NULL WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END"),
]


def product_frame(part: DataFrame) -> DataFrame:
    """Product table (all text columns + ``product_id``) derived from ``part``."""
    return part.selectExpr(*[f"{expr} AS `{name}`" for name, expr in PRODUCT_EXPRS])


def product_sql(source: str = "part") -> str:
    """DuckDB SELECT producing the same product table."""
    cols = ",\n  ".join(f'{expr} AS "{name}"' for name, expr in PRODUCT_EXPRS)
    return f"SELECT\n  {cols}\nFROM {source}"


def product_csv_schema(columns: list[str] | None = None) -> T.StructType:
    """Explicit all-string schema: no inference on load."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in (columns or PRODUCT_COLUMNS)])


def load_product_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                     multi_line: bool = True) -> DataFrame:
    """Read a product CSV with header; pandas-style null tokens become null.

    With ``multi_line`` quoted fields may hold line feeds, and a file is read by one
    task; without it large files are split.
    """
    df = (spark.read.option("header", True).option("multiLine", multi_line)
          .option("quote", '"').option("escape", '"')
          .schema(product_csv_schema(columns)).csv(path))
    return df.select(*[
        F.when(F.col(f"`{c}`").isin(CSV_NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c)
        for c in df.columns
    ])
