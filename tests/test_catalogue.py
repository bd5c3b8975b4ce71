from pyspark.sql import functions as F

from shelfwise.functions.prompts import RESULTS_EMPTY, render_per_query
from shelfwise.operators.catalogue import search_catalogue

DEMO = [
    (1, "Wireless Over-Ear Headphones", 89.99, "Electronics", "Noise cancelling, 30 h battery", "https://e.x/1"),
    (2, "Budget On-Ear Headphones", 39.99, "Audio", "Light and foldable", "https://e.x/2"),
    (3, "Wooden Stacking Blocks", 24.0, "Toys & Games", "Forty pieces for ages 2 and up", "https://e.x/3"),
    (4, "Wireless Over-Ear Headphones", 79.0, "Electronics", "Second listing of the same name", "https://e.x/4"),
    (5, "Shape Sorter", 19.99, "Educational Toys", "Twelve shapes", "https://e.x/5"),
    (6, "Reading Tablet", 134.5, "Educational Electronics", "Stylus included", "https://e.x/6"),
]


def _search(spark, queries, k=5):
    p = spark.createDataFrame(DEMO, "product_id long, name string, price double, category string, description string, url string")
    q = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    return search_catalogue(p, q, k), q


def _names(res, q):
    return [r.name for r in res.where(F.col("query_id") == q).orderBy("rank").collect()]


def test_keyword_price_category_rules(spark):
    res, _ = _search(spark, ["headphones", "gift under $50", "toys", "tablet", "nothing matches"])
    assert _names(res, "headphones") == ["Wireless Over-Ear Headphones", "Budget On-Ear Headphones"]
    assert _names(res, "gift under $50") == ["Budget On-Ear Headphones", "Wooden Stacking Blocks", "Shape Sorter"]
    assert _names(res, "toys") == ["Wooden Stacking Blocks", "Shape Sorter"]
    assert _names(res, "tablet") == ["Reading Tablet"]
    assert _names(res, "nothing matches") == []
    # first product of a repeated name is kept
    assert res.where("query_id = 'headphones' AND rank = 1").first().product_id == 1


def test_limit_and_render(spark):
    res, q = _search(spark, ["e", "zzz"], k=3)
    assert len(_names(res, "e")) == 3
    out = {r.query_id: r for r in render_per_query(res, q).collect()}
    assert out["zzz"].results_markdown == RESULTS_EMPTY
    assert out["zzz"].prompt.startswith("User asked: zzz")
    md = out["e"].results_markdown
    assert md.startswith("**Search Results:**\n\n**1. Wireless Over-Ear Headphones**\n")
    assert "Price: $89.99" in md and "[View Product](https://e.x/1)" in md
    assert out["e"].prompt.startswith("User query: e\n\nSearch results:\n1. Product: Wireless Over-Ear Headphones | Price: $89.99")


def test_products_and_grams_are_never_broadcast(spark, tmp_path):
    """Both look small by the size of their files; the driver must not hold them."""
    path = str(tmp_path / "products")
    spark.range(300).selectExpr(
        "id AS product_id", "'red mug ' || id % 7 AS name", "id * 1.0D AS price", "'MUGS' AS category",
        "'Made by ' || id % 3 AS description", "'https://shop.example.com/' || id AS url").write.parquet(path)
    products = spark.read.parquet(path)
    queries = products.selectExpr("name AS query_id", "name AS query").distinct()
    plan = search_catalogue(products, queries)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4
