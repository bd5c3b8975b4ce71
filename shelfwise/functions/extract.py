"""Field extraction by a pattern table.

Patterns are configuration (a short list), so they compile into Column
expressions: no join against a pattern table, everything stays in codegen'd
JVM expressions. Each pattern is a case-insensitive *search*; the value is
group 1, stripped. A text with a match whose group is blank yields ``''``
(found, empty), distinct from no match (null).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FIELD_QUERY_INDICATORS, FUZZY_THRESHOLD
from .text import strip, whitespace_words


@dataclass(frozen=True)
class FieldPattern:
    field_name: str
    regex: str
    priority: int
    description: str
    keywords: tuple[str, ...] = field(default_factory=tuple)


# ---------------------------------------------------------------------------
# FIXED VALUES: the default pattern table (field, regex, priority, description,
# keywords), in declared order. Regexes are matched case-insensitively.
# ---------------------------------------------------------------------------
DEFAULT_PATTERNS: tuple[FieldPattern, ...] = (
    FieldPattern("price", r"(?:Price|Cost|Selling\s+Price):\s*\$?([0-9]+(?:\.[0-9]+)?)", 1,
                 "Product price in USD", ("price", "cost", "pricing", "amount", "dollar", "usd")),
    FieldPattern("dimensions",
                 r"(?:Product\s*Dimensions?|Size):\s*([0-9.]+\s*x\s*[0-9.]+(?:\s*x\s*[0-9.]+)?(?:\s*(?:inches?|in|cm|mm))?)",
                 1, "Product dimensions", ("dimension", "dimensions", "size", "width", "height", "length")),
    FieldPattern("weight", r"(?:Item\s*Weight|Shipping\s*Weight):\s*([0-9.]+\s*(?:pounds?|lbs?|kg|ounces?|oz))", 1,
                 "Product weight", ("weight", "heavy", "pounds", "lbs", "kg", "ounces", "oz")),
    FieldPattern("asin", r"ASIN:\s*([A-Za-z0-9]+)", 2, "Amazon ASIN identifier", ("asin", "identifier", "id")),
    FieldPattern("model", r"(?:Item\s*Model\s*Number|Model):\s*([A-Za-z0-9\-_]+)", 2, "Product model number",
                 ("model", "model number", "part number", "sku")),
    FieldPattern("age", r"(?:Manufacturer\s*Recommended\s*Age|Ages?):\s*([0-9\-\+\s]*(?:years?|months?)[^|]*)", 2,
                 "Recommended age range", ("age", "recommended age", "years", "children", "kids")),
    FieldPattern("shipping", r"(?:Domestic\s*Shipping|International\s*Shipping):\s*([^|]+)", 3,
                 "Shipping information", ("shipping", "delivery", "international", "domestic")),
    FieldPattern("brand", r"(?:Brand|Manufacturer):\s*([^|]+)", 2, "Product brand",
                 ("brand", "manufacturer", "company", "made by")),
    FieldPattern("color", r"(?:Color|Colour):\s*([^|]+)", 3, "Product color", ("color", "colour", "colors", "colours")),
    FieldPattern("battery", r"(?:Batteries?|Power):\s*([^|]+)", 3, "Battery requirements",
                 ("battery", "batteries", "power", "aa", "aaa")),
    FieldPattern("material", r"(?:Material|Made\s+of|Fabric):\s*([^|]+)", 3, "Product material",
                 ("material", "made of", "fabric", "plastic", "wood", "metal")),
    FieldPattern("rating", r"(?:Rating|Score):\s*([0-9.]+(?:\s*out\s*of\s*[0-9]+)?(?:\s*stars?)?)", 3,
                 "Product rating", ("rating", "stars", "review", "score")),
)

# FIXED VALUES: price-like patterns tried in order when inferring a price.
PRICE_INFER_PATTERNS = (r"\$([0-9]+(?:\.[0-9]+)?)", r"([0-9]+(?:\.[0-9]+)?)\s*(?:dollars?|usd)")

# Java regex flag for case-insensitive matching with Unicode case folding.
_FLAGS = "(?iu)"


class PatternTable:
    """Ordered pattern list; ``add_custom_pattern`` makes a new table."""

    def __init__(self, patterns=DEFAULT_PATTERNS):
        self.patterns: list[FieldPattern] = list(patterns)

    def add_custom_pattern(self, keywords, pattern_str: str, field_name: str, description: str,
                           priority: int = 2) -> "PatternTable":
        """A new table with one more pattern. The pattern is tried by the engine that
        will run it (Java's, with group 1), so what passes here runs in a job."""
        try:  # the empty alternative matches, so the engine looks up group 1 too
            SparkSession.active().range(1).select(F.regexp_extract(F.lit(""), f"{_FLAGS}(?:{pattern_str})|", 1)).collect()
        except Exception as e:
            raise ValueError(f"not a pattern with a group for this engine: {pattern_str}") from e
        return PatternTable([*self.patterns, FieldPattern(field_name, pattern_str, priority, description, tuple(keywords))])

    def by_priority(self) -> list[tuple[int, FieldPattern]]:
        """(declared position, pattern) sorted by priority; stable within a priority."""
        return sorted(enumerate(self.patterns), key=lambda x: x[1].priority)

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("ord", T.IntegerType()), T.StructField("field_name", T.StringType()),
            T.StructField("regex", T.StringType()), T.StructField("priority", T.IntegerType()),
            T.StructField("description", T.StringType()),
            T.StructField("keywords", T.ArrayType(T.StringType()))])
        return spark.createDataFrame(
            [(i, p.field_name, p.regex, p.priority, p.description, list(p.keywords))
             for i, p in enumerate(self.patterns)], schema)


DEFAULT_TABLE = PatternTable()


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def search_group1(text, regex: str) -> Column:
    """Group 1 of the first match, stripped; null when nothing matches."""
    found = F.try_element_at(F.regexp_extract_all(_c(text), F.lit(_FLAGS + regex), 1), F.lit(1))
    return strip(found)


def _keyword_hit(query_lower: Column, keywords) -> Column:
    cond = F.lit(False)
    for k in keywords:
        cond = cond | query_lower.contains(k)
    return cond


def extract_all_fields(text, table: PatternTable = DEFAULT_TABLE) -> Column:
    """map field -> value of every matching pattern (a later duplicate field wins)."""
    values: dict[str, Column] = {}
    for p in table.patterns:
        v = search_group1(text, p.regex)
        values[p.field_name] = F.coalesce(v, values[p.field_name]) if p.field_name in values else v
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def extract_field(text, query, table: PatternTable = DEFAULT_TABLE) -> Column:
    """by priority, the first pattern whose keyword is in the query and that matches."""
    ql = F.lower(_c(query))
    out = [F.when(_keyword_hit(ql, p.keywords), search_group1(text, p.regex)) for _, p in table.by_priority()]
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def is_field_query(query) -> Column:
    """the query holds one of the field indicator phrases."""
    return F.coalesce(_keyword_hit(F.lower(_c(query)), FIELD_QUERY_INDICATORS), F.lit(False))


def fuzzy_extract_field(text, query, threshold: float = FUZZY_THRESHOLD,
                        table: PatternTable = DEFAULT_TABLE) -> Column:
    """struct(value, confidence) of the pattern with the best keyword Jaccard.

    Jaccard of the query's whitespace words and the pattern keywords must
    reach ``threshold`` and the pattern must match; the highest similarity
    wins, the first declared on ties. A blank best value gives null.
    """
    qw = F.array_distinct(whitespace_words(F.lower(_c(query))))
    cands = []
    for i, p in enumerate(table.patterns):
        kw = F.array(*[F.lit(k) for k in dict.fromkeys(p.keywords)])
        sim = F.size(F.array_intersect(qw, kw)) / F.size(F.array_union(qw, kw))
        v = search_group1(text, p.regex)
        cands.append(F.when((sim >= threshold) & v.isNotNull(),
                            F.struct(sim.alias("confidence"), F.lit(-i).alias("neg_ord"), v.alias("value"))))
    best = F.greatest(*cands) if len(cands) > 1 else cands[0]
    return F.when(best.isNotNull() & (best["value"] != ""),
                  F.struct(best["value"].alias("value"), best["confidence"].alias("confidence")))


def infer_price(text) -> Column:
    """first ``$n`` or ``n dollars/usd`` in the text, as ``$n``."""
    vals = [F.try_element_at(F.regexp_extract_all(_c(text), F.lit(_FLAGS + r), 1), F.lit(1))
            for r in PRICE_INFER_PATTERNS]
    v = F.coalesce(*vals)
    return F.when(v.isNotNull(), F.concat(F.lit("$"), v))


def context_aware_extract(text, query, category, threshold: float = FUZZY_THRESHOLD,
                          table: PatternTable = DEFAULT_TABLE) -> Column:
    """exact (non-blank), else fuzzy, else a price from the text when a
    category is given and the query mentions price."""
    exact = extract_field(text, query, table)
    fuzzy = fuzzy_extract_field(text, query, threshold, table)
    cat = _c(category)
    price = F.when(cat.isNotNull() & (cat != "") & F.lower(_c(query)).contains("price"), infer_price(text))
    return (F.when(exact.isNotNull() & (exact != ""), exact)
            .when(fuzzy.isNotNull() & (fuzzy["confidence"] >= threshold), fuzzy["value"])
            .otherwise(price))


def extracted_long(df: DataFrame, id_col: str, text_col: str, table: PatternTable = DEFAULT_TABLE) -> DataFrame:
    """F14 long form: ``(id, field, value)``, one row per extracted field."""
    return df.select(id_col, F.explode(extract_all_fields(text_col, table)).alias("field", "value"))


def field_suggestions(df: DataFrame, id_col: str, text_col: str, table: PatternTable = DEFAULT_TABLE) -> DataFrame:
    """F16: one suggestion per pattern whose field was extracted:
    ``(id, field, description, value, keywords)`` with the first 3 declared keywords."""
    spark = df.sparkSession
    meta = table.to_df(spark).select(F.col("field_name").alias("field"), "description",
                                     F.slice("keywords", 1, 3).alias("keywords"))
    # the pattern table is bounded configuration: broadcast it
    return extracted_long(df, id_col, text_col, table).join(F.broadcast(meta), "field")


def extraction_report(df: DataFrame, id_col: str, text_col: str, table: PatternTable = DEFAULT_TABLE):
    """A4: (totals row, per-field counts, first 5 samples by id with a 100-char preview)."""
    fields = df.select(id_col, text_col, extract_all_fields(text_col, table).alias("fields"))
    totals = fields.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.sum(F.when(F.size("fields") > 0, 1).otherwise(0)).cast("long").alias("successful_extractions"),
    ).withColumn("extraction_rate", F.col("successful_extractions") / F.col("total_texts"))
    counts = (fields.select(F.explode(F.map_keys("fields")).alias("field"))
              .groupBy("field").agg(F.count(F.lit(1)).alias("n")))
    t = F.col(text_col)
    preview = F.when(F.length(t) > 100, F.concat(F.substring(t, 1, 100), F.lit("..."))).otherwise(t)
    samples = (fields.orderBy(id_col).limit(5)
               .select(id_col, preview.alias("text_preview"), "fields"))
    return totals, counts, samples


def pattern_diagnostics(table: PatternTable, spark: SparkSession) -> DataFrame:
    """A5: totals, per-priority counts, distinct keywords/fields, duplicate fields (one row)."""
    p = table.to_df(spark)
    return p.agg(
        F.count(F.lit(1)).alias("total_patterns"),
        F.collect_list("priority").alias("_pri"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keyword_coverage"),
        F.collect_list("field_name").alias("_fields"),
    ).select(
        "total_patterns",
        F.map_from_entries(F.transform(
            F.array_sort(F.array_distinct("_pri")),
            lambda x: F.struct(x.alias("priority"), F.size(F.filter("_pri", lambda y: y == x)).alias("n"))))
        .alias("patterns_by_priority"),
        "keyword_coverage",
        F.array_sort(F.array_distinct("_fields")).alias("field_coverage"),
        F.array_sort(F.filter(F.array_distinct("_fields"),
                              lambda f: F.size(F.filter("_fields", lambda g: g == f)) > 1)).alias("duplicate_fields"),
    )
