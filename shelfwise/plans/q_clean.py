"""Queries: cleaning, validation, text tokens, ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FILL_COLUMNS, NOT_AVAILABLE
from ..functions.text import SPACE, overlap, token_set
from ..operators import clean, truth
from ..sources.tables import read_table
from .registry import PRODUCTS_CTE, products, register

WORD_RE = r"([\p{L}\p{N}_]+)"

# -- shared oracle fragments --------------------------------------------------

_KEPT = ["product_id", "Uniq Id", "Product Name", "Category", "Selling Price", "Model Number",
         "About Product", "Product Specification", "Technical Details", "Shipping Weight",
         "Product Dimensions", "Image", "Variants", "Product Url", "Is Amazon Seller"]


def _cleaned_select() -> str:
    cols = []
    for c in _KEPT:
        if c in FILL_COLUMNS:
            cols.append(f"coalesce(\"{c}\", '{NOT_AVAILABLE}') AS \"{c}\"")
        else:
            cols.append(f'"{c}"')
    return "SELECT " + ", ".join(cols) + " FROM products"


CLEANED_CTE = f"{PRODUCTS_CTE},\ncleaned AS ({_cleaned_select()})"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"


_NA = f"'{NOT_AVAILABLE}'"
COMBINED_SQL = (
    "concat_ws(' | ', 'Product Name: ' || \"Product Name\", "
    f"CASE WHEN \"Category\" <> {_NA} THEN 'Category: ' || \"Category\" END, "
    f"CASE WHEN \"Selling Price\" <> {_NA} THEN 'Price: ' || \"Selling Price\" END, "
    f"CASE WHEN \"Model Number\" <> {_NA} THEN 'Model: ' || \"Model Number\" END, "
    f"CASE WHEN \"About Product\" <> {_NA} THEN 'About: ' || \"About Product\" END)"
)
REASON_SQL = (
    "CASE WHEN \"Product Name\" IS NULL THEN 'missing product name' "
    "WHEN \"Image\" IS NULL THEN 'missing image_url' "
    "WHEN \"Is Amazon Seller\" IS NULL THEN 'missing is_amazon_seller' "
    f"WHEN NOT coalesce(regexp_matches(\"Product Url\", '{clean.URL_PATTERN}'), false) "
    "THEN 'invalid product_url' END"
)
META_CTE = (
    f"{CLEANED_CTE},\nmeta_all AS (SELECT product_id, \"Image\" AS image_url, \"Product Url\" AS product_url, "
    f"coalesce(\"Variants\", {_NA}) AS variants_products_link, "
    f"coalesce(\"Shipping Weight\", {_NA}) AS shipping_weight, "
    f"coalesce(\"Product Dimensions\", {_NA}) AS product_dimensions, "
    f"coalesce(\"Product Specification\", {_NA}) AS product_specification, "
    f"coalesce(\"Technical Details\", {_NA}) AS technical_details, "
    f"\"Is Amazon Seller\" AS is_amazon_seller, {COMBINED_SQL} AS combined_text, "
    f"{REASON_SQL} AS reject_reason FROM cleaned),\n"
    "meta AS (SELECT * EXCLUDE (reject_reason) FROM meta_all WHERE reject_reason IS NULL)"
)

META_COLS = ("product_id, image_url, product_url, variants_products_link, shipping_weight, "
             "product_dimensions, product_specification, technical_details, is_amazon_seller, "
             "combined_text")


def cleaned(spark, sf):
    """Cleaned products over the known columns; only ``clean_products`` pays for
    finding out which columns hold nothing."""
    return clean.fill_not_available(products(spark, sf).select(*[F.col(f"`{c}`") for c in _KEPT]))


def metadata(spark, sf):
    return clean.create_metadata(cleaned(spark, sf))


# -- C1-C3 ---------------------------------------------------------------------

@register("clean_products", f"WITH {CLEANED_CTE} SELECT * FROM cleaned")
def q_clean_products(spark, sf):
    return clean.clean_products(products(spark, sf))


# -- C4, C5 --------------------------------------------------------------------

@register("metadata_accept", f"WITH {META_CTE} SELECT {META_COLS} FROM meta")
def q_metadata_accept(spark, sf):
    return metadata(spark, sf)[0]


@register("metadata_reject",
          f"WITH {META_CTE} SELECT product_id, reject_reason FROM meta_all WHERE reject_reason IS NOT NULL")
def q_metadata_reject(spark, sf):
    return metadata(spark, sf)[1]


# -- C7 ------------------------------------------------------------------------

HOST_RE = r"^https?://([^/?#\s:@]+)"


@register("url_valid",
          f"SELECT page_id, url, coalesce(regexp_matches(url, '{clean.URL_PATTERN}'), false) AS url_valid, "
          f"CASE WHEN coalesce(regexp_matches(url, '{clean.URL_PATTERN}'), false) "
          f"THEN regexp_extract(url, '{HOST_RE}', 1) END AS host FROM pages")
def q_url_valid(spark, sf):
    pages = read_table(spark, sf, "pages", ["page_id", "url"])
    valid = clean.url_is_valid("url")
    return pages.select("page_id", "url", valid.alias("url_valid"),
                        F.when(valid, F.regexp_extract("url", HOST_RE, 1)).alias("host"))


# -- C8 ------------------------------------------------------------------------

@register("quality_gate",
          "SELECT count(*) AS n_rows, "
          "CAST(sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, "
          "CAST(sum(CASE WHEN embedding IS NOT NULL AND len(embedding) <> 64 THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong_dim, "
          "CAST(sum(CASE WHEN list_bool_or(list_transform(embedding, lambda x: isnan(x))) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan, "
          "CAST(0 AS BIGINT) AS n_missing_columns FROM embeddings")
def q_quality_gate(spark, sf):
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return clean.quality_report(emb, 64, ["vec_id", "embedding"])


# -- C9, C10 -------------------------------------------------------------------

_FIRST = sql_strip("split_part(image_url, '|', 1)")


@register("train_filter",
          f"WITH {META_CTE} SELECT product_id, {_FIRST} AS first_image FROM meta "
          f"WHERE combined_text IS NOT NULL AND length({sql_strip('combined_text')}) > 10 "
          f"AND image_url IS NOT NULL AND image_url <> '' AND {_FIRST} <> '' "
          f"AND NOT contains(lower({_FIRST}), 'transparent-pixel')")
def q_train_filter(spark, sf):
    return (clean.training_rows(metadata(spark, sf)[0])
            .select("product_id", clean.first_url("image_url").alias("first_image")))


@register("image_urls",
          f"WITH {META_CTE}, l AS (SELECT product_id, string_split(image_url, '|') AS urls FROM meta) "
          f"SELECT product_id, CAST(unnest(range(len(urls))) AS INTEGER) AS pos, "
          f"{sql_strip('unnest(urls)')} AS url FROM l")
def q_image_urls(spark, sf):
    return clean.all_urls(metadata(spark, sf)[0], "product_id", "image_url")


# -- C11 -----------------------------------------------------------------------

@register("split_80_20",
          f"WITH {META_CTE} SELECT product_id, CASE WHEN row_number() OVER (ORDER BY product_id) - 1 "
          f"< floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'validation' END AS split FROM meta")
def q_split(spark, sf):
    return clean.positional_split(metadata(spark, sf)[0], "product_id").select("product_id", "split")


# -- C15 -----------------------------------------------------------------------

REQUESTS_SQL = ("SELECT item_id AS query_id, CASE WHEN item_id % 13 = 5 THEN NULL ELSE text END AS text_query, "
                "CAST(item_id % 60 - 4 AS INTEGER) AS k, item_id % 2 = 0 AS rerank FROM benchmark")


def requests(spark, sf):
    b = read_table(spark, sf, "benchmark", ["item_id", "text"])
    return b.selectExpr("item_id AS query_id",
                        "CASE WHEN item_id % 13 = 5 THEN NULL ELSE text END AS text_query",
                        "CAST(item_id % 60 - 4 AS INT) AS k", "item_id % 2 = 0 AS rerank")


@register("validate_requests",
          f"WITH r AS ({REQUESTS_SQL}) SELECT query_id, k, "
          "CASE WHEN text_query IS NULL OR text_query = '' THEN 'no text or image query' "
          "WHEN k IS NULL OR k < 1 OR k > 50 THEN 'k must be in 1..50' END AS reject_reason FROM r")
def q_validate_requests(spark, sf):
    return clean.validate_requests(requests(spark, sf), image_col=None).select("query_id", "k", "reject_reason")


# -- X1, X2 --------------------------------------------------------------------

@register("tokens",
          f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, list_sort(t) AS tokens FROM "
          f"(SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{WORD_RE}', 1)) AS t FROM documents)")
def q_tokens(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    t = token_set("text")
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_sort(t).alias("tokens"))


@register("overlap",
          f"SELECT u.conv_id, u.turn, CAST(len(list_intersect("
          f"list_distinct(regexp_extract_all(lower(u.text), '{WORD_RE}', 1)), "
          f"list_distinct(regexp_extract_all(lower(a.text), '{WORD_RE}', 1)))) AS BIGINT) AS overlap "
          f"FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
          f"WHERE u.role = 'user' AND a.role = 'assistant'")
def q_overlap(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    u = c.where(F.col("role") == "user").select("conv_id", "turn", token_set("text").alias("ut"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), token_set("text").alias("at"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", overlap("ut", "at").cast("long").alias("overlap"))


# -- J2 ------------------------------------------------------------------------

GT_TOKENS_CTE = (f"{CLEANED_CTE},\ngt AS (SELECT product_id, \"Category\" AS category, "
                 f"list_distinct(regexp_extract_all(lower(\"Product Name\"), '{WORD_RE}', 1)) AS toks FROM cleaned)")


@register("ground_truth_pairs",
          f"WITH {GT_TOKENS_CTE} SELECT a.product_id AS query_id, b.product_id AS match_id "
          f"FROM gt a JOIN gt b ON a.category = b.category AND a.product_id <> b.product_id "
          f"WHERE len(list_intersect(a.toks, b.toks)) >= 2")
def q_ground_truth(spark, sf):
    return truth.truth_pairs(cleaned(spark, sf))


@register("has_truth",
          f"WITH {GT_TOKENS_CTE} SELECT DISTINCT a.product_id AS pid "
          f"FROM gt a JOIN gt b ON a.category = b.category AND a.product_id <> b.product_id "
          f"WHERE len(list_intersect(a.toks, b.toks)) >= 2")
def q_has_truth(spark, sf):
    return truth.has_truth(cleaned(spark, sf))
