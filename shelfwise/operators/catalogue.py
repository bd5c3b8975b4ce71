"""Catalogue keyword search.

A product matches a query when the query text is a substring of its name,
description or category; or the query asks ``under $100`` (else ``under $50``)
and the price is below that; or the query says ``headphones`` and so does the
name (else ``toys`` and the category). Results keep the first product of each
name (catalogue order = ``product_id``) and the first ``max_results`` names.

Plan, without any query x product cross join:

* the final list is the first ``max_results`` names of a union, so it equals
  the first names over the union of each part's own first names;
* substring part: products explode their character grams (lengths
  1..``gram``, plain codegen'd ``substring`` after ``explode(sequence)``), kept
  only where some query needs the gram (semi-join) and checkpointed once. A
  query no longer than ``gram`` *is* a gram: its answer is the per-gram first
  names. A longer query joins on its rarest ``gram``-gram (frequencies from
  the same index) and each candidate is verified with an exact ``contains``;
* rule parts (price phrases, category words, the empty query) do not depend on
  the query text beyond a flag: their first names are computed once (at most
  ``max_results`` rows per rule) and attached to flagged queries as literals.

The grams and the products meet others by sort-merge (``as_large``): estimated from
``part``'s small file both look fit to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATALOGUE_MAX_RESULTS
from ..sources.tables import as_large

# FIXED VALUES: the demo search's price and category phrases, in checking order.
PRICE_RULES = [("under $100", 100.0), ("under $50", 50.0)]
CATEGORY_RULES = [("headphones", "name"), ("toys", "category")]


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    ).otherwise(F.array().cast("array<string>"))


def _first_names(df: DataFrame, key: list[str], k: int) -> DataFrame:
    """First ``k`` names per key, each name represented by its smallest product id."""
    firsts = df.groupBy(*key, "name").agg(F.min("product_id").alias("product_id"))
    w = Window.partitionBy(*key).orderBy("product_id")
    return firsts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _fields() -> list[Column]:
    return [F.lower(F.col(c)) for c in ("name", "description", "category")]


def first_names_by_rule(p: DataFrame, k: int) -> DataFrame:
    """(rule, product_id, name): the first ``k`` names of every rule part."""
    low = _fields()
    (_, lim100), (_, lim50) = PRICE_RULES
    (w1, f1), (w2, f2) = CATEGORY_RULES
    field = {"name": low[0], "category": low[2]}
    rule_flags = F.array(
        F.when(F.col("price") < lim100, F.lit("p100")), F.when(F.col("price") < lim50, F.lit("p50")),
        F.when(field[f1].contains(w1), F.lit("c1")), F.when(field[f2].contains(w2), F.lit("c2")),
        F.lit("all"))
    tagged = p.select("product_id", "name", F.explode(F.filter(rule_flags, lambda x: x.isNotNull())).alias("rule"))
    return _first_names(tagged, ["rule"], k)


def rule_candidates(q: DataFrame, key: str, rule_rows: list) -> DataFrame:
    """(key, product_id, name): the rules' first names for every query (column ql) that a rule applies to."""
    per_rule: dict[str, list] = {}
    for r in rule_rows:
        per_rule.setdefault(r["rule"], []).append((r["product_id"], r["name"]))

    def lit_set(rule: str) -> Column:
        items = per_rule.get(rule, [])
        return F.array(*[F.struct(F.lit(i).cast("long").alias("product_id"), F.lit(n).alias("name"))
                         for i, n in items]) if items else F.array().cast("array<struct<product_id:bigint,name:string>>")

    (p100, _), (p50, _) = PRICE_RULES
    (w1, _), (w2, _) = CATEGORY_RULES
    ql = F.col("ql")
    empty = lit_set("all").cast("array<struct<product_id:bigint,name:string>>")
    none = F.array().cast("array<struct<product_id:bigint,name:string>>")
    rule_cands = F.concat(
        F.when(ql.contains(p100), lit_set("p100")).when(ql.contains(p50), lit_set("p50")).otherwise(none),
        F.when(ql.contains(w1), lit_set("c1")).otherwise(none),
        F.when(ql.contains(w2), lit_set("c2")).otherwise(none),
        F.when(ql == "", empty).otherwise(none))
    return (q.select(key, F.explode(rule_cands).alias("c"))
            .select(key, F.col("c.product_id").alias("product_id"), F.col("c.name").alias("name")))


def search_catalogue(products: DataFrame, queries: DataFrame, max_results: int = CATALOGUE_MAX_RESULTS,
                     gram: int = 3) -> DataFrame:
    """``(query_id, rank, product_id, name, price, category, description, url)``.

    ``products``: (product_id, name, price, category, description, url);
    ``queries``: (query_id, query).
    """
    k = max_results
    p = products.select("product_id", "name", "price", "category", "description", "url")
    low = _fields()
    q = queries.select("query_id", F.lower("query").alias("ql")).where(F.col("ql").isNotNull())

    from_rules = rule_candidates(q, "query_id", first_names_by_rule(p, k).collect())   # at most 5 rules x k rows

    # -- substring part: character-gram index, restricted to grams queries need ------------
    short = q.where((F.length("ql") >= 1) & (F.length("ql") <= gram))
    long_q = q.where(F.length("ql") > gram)
    qg = long_q.select("query_id", "ql", F.explode(F.array_distinct(_grams(F.col("ql"), gram))).alias("g"))
    needed = short.select(F.col("ql").alias("g")).unionByName(qg.select("g")).distinct()
    fields = p.select("product_id", "name", F.explode(F.array(*low)).alias("t")).where(F.col("t").isNotNull())
    pos = fields.select("product_id", "name", "t", F.explode(F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1)))).alias("i"))
    grams_at = F.array(*[F.when(F.col("i") + (n - 1) <= F.length("t"), F.substring("t", F.col("i"), F.lit(n)))
                         for n in range(1, gram + 1)])
    index = (pos.select("product_id", "name", F.explode(grams_at).alias("g"))
             .where(F.col("g").isNotNull())
             .join(needed, "g", "left_semi"))
    index = index.checkpoint()  # read three times below

    short_names = _first_names(as_large(index).join(short.select(F.col("ql").alias("g")).distinct(), "g"), ["g"], k)
    from_short = short.join(short_names, short["ql"] == short_names["g"]).select("query_id", "product_id", "name")

    freq = index.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    rarest = (qg.join(freq, "g").groupBy("query_id", "ql")
              .agg(F.min_by("g", F.struct("f", "g")).alias("g")))
    cands = rarest.join(as_large(index.select("g", "product_id")), "g").join(as_large(p), "product_id")
    texts_match = (F.lower("name").contains(F.col("ql")) | F.lower("description").contains(F.col("ql"))
                   | F.lower("category").contains(F.col("ql")))
    from_long = cands.where(F.coalesce(texts_match, F.lit(False))).select("query_id", "product_id", "name")

    # -- union of parts -> first names per query ------------------------------------------
    allc = from_rules.unionByName(from_short).unionByName(from_long)
    top = _first_names(allc, ["query_id"], k).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("product_id")))
    return top.select("query_id", "rank", "product_id").join(as_large(p), "product_id")
