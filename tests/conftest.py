import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from shelfwise.session import ensure_checkpoint_dir, ship_package

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    ship_package(s)
    yield s


PRODUCT_ROWS = [
    # Uniq Id, Product Name, Category, Selling Price, Model Number, About Product,
    # Product Specification, Technical Details, Shipping Weight, Product Dimensions,
    # Image, Variants, Product Url, Is Amazon Seller
    ("p1", "Trail Runner Water Bottle", "Sports & Outdoors", "$19.50", "TR-500",
     "Keeps drinks cold for a day", "Capacity: 750 ml", "Material: steel | Color: blue",
     "0.8 pounds", "3 x 3 x 10 inches", "https://img.example.com/1.jpg|https://img.example.com/1b.jpg",
     None, "https://shop.example.com/p/1", "Y"),
    ("p2", "Desk Lamp LED", None, None, None, None, None, None, None, None,
     "https://img.example.com/2.jpg", None, "https://shop.example.com/p/2", "N"),
]


@pytest.fixture
def product_df(spark):
    from shelfwise.sources.products import PRODUCT_COLUMNS, product_csv_schema

    df = spark.createDataFrame(PRODUCT_ROWS, product_csv_schema(PRODUCT_COLUMNS))
    from pyspark.sql import functions as F
    return df.withColumn("product_id", F.monotonically_increasing_id()) \
        .withColumn("Upc Ean Code", F.lit("000123")).withColumn("Empty Col", F.lit(None).cast("string"))
