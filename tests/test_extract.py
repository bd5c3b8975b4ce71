import pytest
from pyspark.sql import functions as F

from shelfwise.functions import extract as X

TEXT = ("Product Name: Kettle | Selling Price: $2,399.00 | Product Dimensions: 9.94 x 7.27 x 3.03 inches | "
        "Item Weight: 2.5 pounds | ASIN: B00ABC123 | Item Model Number: KT-100_v2 | Ages: 3 years and up | "
        "Domestic Shipping: ships to the US | Brand:   Acme  | Color: red | Batteries: 2 AA required | "
        "Material: steel | Rating: 4.5 out of 5 stars")


def _one(spark, text=TEXT, query="what is the price"):
    return spark.createDataFrame([(1, text, query, "Kitchen")], "id int, text string, q string, cat string")


def test_extract_all_fields(spark):
    m = _one(spark).select(X.extract_all_fields("text").alias("m")).first().m
    assert m["price"] == "2"  # no thousands separator in the pattern
    assert m["dimensions"] == "9.94 x 7.27 x 3.03 inches"
    assert m["weight"] == "2.5 pounds" and m["asin"] == "B00ABC123" and m["model"] == "KT-100_v2"
    assert m["age"] == "3 years and up" and m["shipping"] == "ships to the US"
    assert m["brand"] == "Acme" and m["color"] == "red" and m["battery"] == "2 AA required"
    assert m["material"] == "steel" and m["rating"] == "4.5 out of 5 stars"


def test_battery_singular_does_not_match(spark):
    m = _one(spark, "Battery: 1 CR2032").select(X.extract_all_fields("text").alias("m")).first().m
    assert "battery" not in m


def test_extract_field_by_priority_and_keywords(spark):
    df = spark.createDataFrame([(1, TEXT, "how heavy and what size is it"), (2, TEXT, "tell me a joke"),
                                (3, "Color: blue", "what colour and model")],
                               "id int, text string, q string")
    r = {x.id: x.v for x in df.select("id", X.extract_field("text", "q").alias("v")).collect()}
    assert r[1] == "9.94 x 7.27 x 3.03 inches"  # dimensions and weight are both priority 1; dimensions declared first
    assert r[2] is None
    assert r[3] == "blue"  # model (priority 2) does not match the text, color (3) does


def test_field_query_and_fuzzy(spark):
    df = spark.createDataFrame([(1, TEXT, "What's the deal"), (2, TEXT, "color colour colors colours"),
                                (3, TEXT, "color please")], "id int, text string, q string")
    r = df.select("id", X.is_field_query("q").alias("f"), X.fuzzy_extract_field("text", "q").alias("z")).orderBy("id").collect()
    assert [x.f for x in r] == [True, False, False]
    assert r[0].z is None and r[1].z.value == "red" and r[1].z.confidence == 1.0 and r[2].z is None


def test_context_aware_and_price_inference(spark):
    df = spark.createDataFrame([(1, "Great value at 45 dollars today", "price please", "Kitchen"),
                                (2, "Great value at 45 dollars today", "price please", None),
                                (3, "on sale $12.50 now", "what price", "Toys")], "id int, text string, q string, cat string")
    r = {x.id: x.v for x in df.select("id", X.context_aware_extract("text", "q", "cat").alias("v")).collect()}
    assert r == {1: "$45", 2: None, 3: "$12.50"}


def test_custom_pattern_and_diagnostics(spark):
    t = X.PatternTable()
    for bad in ("Warranty: ([", "(?P<n>x)", "Warranty: no group"):
        with pytest.raises(ValueError, match="not a pattern"):
            t.add_custom_pattern({"warranty"}, bad, "warranty", "Warranty")
    t = t.add_custom_pattern(["warranty"], r"Warranty:\s*([^|]+)", "warranty", "Warranty length", priority=1)
    t = t.add_custom_pattern(["hue"], r"Hue:\s*([^|]+)", "color", "Second color pattern", priority=3)
    df = spark.createDataFrame([(1, "Warranty: 2 years | Color: red | Hue: crimson")], "id int, text string")
    m = df.select(X.extract_all_fields("text", t).alias("m")).first().m
    assert m["warranty"] == "2 years" and m["color"] == "crimson"  # a later duplicate field wins
    sug = X.field_suggestions(df, "id", "text", t).where("field = 'color'").collect()
    assert sorted(r.description for r in sug) == ["Product color", "Second color pattern"]
    assert len(X.PatternTable().patterns) == len(X.DEFAULT_TABLE.patterns) == 12
    d = X.pattern_diagnostics(t, spark).first()
    assert d.total_patterns == 14 and d.duplicate_fields == ["color"]
    assert d.patterns_by_priority == {1: 4, 2: 4, 3: 6}


def test_suggestions_and_report(spark):
    df = _one(spark)
    s = X.field_suggestions(df, "id", "text").where(F.col("field") == "price").first()
    assert s.keywords == ["price", "cost", "pricing"] and s.description == "Product price in USD"
    totals, counts, samples = X.extraction_report(
        spark.createDataFrame([(1, TEXT), (2, "nothing here")], "id int, text string"), "id", "text")
    t = totals.first()
    assert (t.total_texts, t.successful_extractions, t.extraction_rate) == (2, 1, 0.5)
    assert samples.orderBy("id").first().text_preview.endswith("...")
