from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.constants import NOT_AVAILABLE
from shelfwise.operators import clean


def test_clean_drops_and_fills(product_df):
    c = clean.clean_products(product_df)
    assert "Empty Col" not in c.columns and "Upc Ean Code" not in c.columns
    assert c.count() == 2
    row = c.where(F.col("Uniq Id") == "p2").first()
    assert row["Category"] == NOT_AVAILABLE and row["Selling Price"] == NOT_AVAILABLE


def test_combined_text_labels_and_skips(product_df):
    c = clean.clean_products(product_df)
    rows = {r["Uniq Id"]: r.t for r in c.select("Uniq Id", clean.combined_text(c).alias("t")).collect()}
    assert rows["p1"] == ("Product Name: Trail Runner Water Bottle | Category: Sports & Outdoors | Price: $19.50"
                          " | Model: TR-500 | About: Keeps drinks cold for a day")
    assert rows["p2"] == "Product Name: Desk Lamp LED"
    assert NOT_AVAILABLE not in rows["p2"]


def test_metadata_accepts_and_rejects(product_df):
    bad = product_df.withColumn("Product Url", F.when(F.col("Uniq Id") == "p2", "not a url").otherwise(F.col("Product Url")))
    acc, rej = clean.create_metadata(clean.clean_products(bad))
    assert acc.count() == 1 and rej.first().reject_reason == "invalid product_url"
    m = acc.first()
    assert m.variants_products_link == NOT_AVAILABLE and m.combined_text.startswith("Product Name:")


def test_url_validity(spark):
    df = spark.createDataFrame([("https://a.example.com/x",), ("http://h:8080",), ("ftp://a/b",), ("shop.com/p",),
                                (None,), ("https:///nohost",)], "u string")
    assert [r.v for r in df.select(clean.url_is_valid("u").alias("v")).collect()] == [True, True, False, False, False, False]


def test_training_filter_and_first_url(spark):
    df = spark.createDataFrame([
        (1, "Product Name: long enough text", " https://i/1.jpg |https://i/2.jpg"),
        (2, "short", "https://i/3.jpg"),
        (3, "Product Name: long enough text", "https://i/Transparent-Pixel.gif|https://i/4.jpg"),
        (4, "Product Name: long enough text", " |https://i/5.jpg"),
    ], "product_id int, combined_text string, image_url string")
    kept = clean.training_rows(df).select("product_id", clean.first_url("image_url").alias("u")).collect()
    assert [(r.product_id, r.u) for r in kept] == [(1, "https://i/1.jpg")]
    urls = clean.all_urls(df, "product_id", "image_url").where("product_id = 1").orderBy("pos").collect()
    assert [r.url for r in urls] == ["https://i/1.jpg", "https://i/2.jpg"]


def test_global_position_and_positional_split(spark):
    df = spark.range(0, 1003).select((F.col("id") * 7 % 1003).alias("k")).repartition(5)
    pos = {r.k: r.position for r in clean.global_position(df, "k").collect()}
    assert pos == {k: k for k in range(1003)}
    s = clean.positional_split(df, "k", 0.8)
    assert s.where("split = 'train'").count() == int(1003 * 0.8)
    assert s.where("split = 'train'").agg(F.max("k")).first()[0] == int(1003 * 0.8) - 1


def test_validate_requests(spark):
    req = spark.createDataFrame([(1, "q", 5), (2, None, 5), (3, "q", 0), (4, "q", 51), (5, "", 50)],
                                "query_id int, text_query string, k int")
    r = {x.query_id: x.reject_reason for x in clean.validate_requests(req, image_col=None).collect()}
    assert r[1] is None and r[2] == "no text or image query" and r[3].startswith("k must")
    assert r[4].startswith("k must") and r[5] == "no text or image query"
    big = spark.range(101).selectExpr("id AS query_id", "'q' AS text_query", "5 AS k")
    assert clean.validate_requests(big, image_col=None).where("reject_reason IS NOT NULL").count() == 0
    vec = spark.createDataFrame([(1, None, [0.5], 5), (2, None, [], 5), (3, None, None, 5), (4, "q", None, 5)],
                                "query_id int, text_query string, image_vec array<double>, k int")
    r = {x.query_id: x.reject_reason for x in clean.validate_requests(vec, image_col="image_vec").collect()}
    assert r[1] is None and r[4] is None and r[2] == r[3] == "no text or image query"


def test_positions_do_not_hang_on_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(200_000).select(F.xxhash64("id").alias("k")).repartition(7)
        got = clean.global_position(df, "k")
        assert got.agg(F.countDistinct("position"), F.max("position")).first()[:] == (200_000, 199_999)
        assert got.withColumn("n", F.lag("k").over(Window.orderBy("position"))).where("n > k").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_quality_report(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, None)],
                               "vec_id int, embedding array<double>")
    r = clean.quality_report(df, 2, ["vec_id", "embedding", "label"]).first()
    assert (r.n_rows, r.n_null, r.n_wrong_dim, r.n_nan, r.n_missing_columns) == (4, 1, 1, 1, 1)
