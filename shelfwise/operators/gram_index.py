"""A stored character-gram index for the catalogue search (C12, W4): built once, searched
often, same rows as :func:`catalogue.search_catalogue`.

Under one shared folder::

    texts/       distinct lower-case texts: text_id, text, firsts (its first names, K at most)
    grams/       one row per position of a distinct text: g, salt, text_id, i; bucketed by (g, salt)
    dictionary/  every distinct gram and the number of its positions
    rules/       first names of the rule parts (a few rows)
    products/    the columns that results show
    about/       one row: gram length, buckets, salts, K

A text that a third of the products share (a category) is indexed once, and only its first K
names are kept: the first names of a union are among the first names of its parts. The end of
a text is padded, so that every position starts a gram and a query shorter than a gram is a
prefix of grams, found in the dictionary.

A query takes its PROBES rarest grams with their offsets and meets the index on (g, salt);
positions less offsets that all probes agree on are candidates, verified by ``contains``. The
index is read in its buckets: only the queries' few rows are shuffled to it. A gram's rows are
spread over ``salts`` buckets by text, so a hot gram is no single task. A query with a gram
that the dictionary lacks ends there. Equal query texts are searched once.

Defined cases: null texts and null queries match nothing; the empty query shows the first
names of all; repeated products change nothing (the smallest id of a name counts); an empty
catalogue gives no rows; two texts with one text_id are both candidates and both verified.
A search may ask for K names at most.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CATALOGUE_MAX_RESULTS
from ..sources.tables import as_large
from .catalogue import _fields, _first_names, first_names_by_rule, rule_candidates

GRAM, PROBES, SALTS = 3, 3, 4
COLUMNS = ["product_id", "name", "price", "category", "description", "url"]


def _table(folder: str) -> str:
    return "gram_index_" + hashlib.sha256(folder.encode()).hexdigest()[:16]


def build_gram_index(products: DataFrame, folder: str, max_results: int = CATALOGUE_MAX_RESULTS, gram: int = GRAM,
                     salts: int = SALTS, buckets: int | None = None) -> str:
    """Write the index of ``products`` (product_id, name, price, category, description,
    url) into ``folder``, which must not hold one; return the folder."""
    spark = products.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    products.select(*COLUMNS).write.parquet(f"{folder}/products")
    p = spark.read.parquet(f"{folder}/products")

    fields = p.select("product_id", "name", F.explode(F.array(*_fields())).alias("text")).where(F.col("text").isNotNull())
    first = _first_names(fields, ["text"], max_results)
    (first.groupBy("text").agg(F.collect_list(F.struct("product_id", "name")).alias("firsts"))
     .select(F.xxhash64("text").alias("text_id"), "text", "firsts").write.parquet(f"{folder}/texts"))

    texts = spark.read.parquet(f"{folder}/texts").where(F.length("text") > 0).select("text_id", "text").distinct()
    padded = F.concat("text", F.lit("\0" * (gram - 1)))
    at = (texts.select("text_id", padded.alias("t"), F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
          .select(F.substring("t", F.col("i"), F.lit(gram)).alias("g"),
                  F.pmod(F.xxhash64("text_id"), F.lit(salts)).cast("int").alias("salt"), "text_id", "i"))
    (at.repartition(buckets, "g", "salt").write.option("path", f"{folder}/grams")
     .bucketBy(buckets, "g", "salt").sortBy("g", "salt").saveAsTable(_table(folder)))

    (spark.table(_table(folder)).groupBy("g").agg(F.count(F.lit(1)).alias("f"))
     .write.parquet(f"{folder}/dictionary"))
    first_names_by_rule(p, max_results).write.parquet(f"{folder}/rules")
    (spark.createDataFrame([(gram, buckets, salts, max_results)], "gram int, buckets int, salts int, k int")
     .coalesce(1).write.parquet(f"{folder}/about"))
    return folder


def _grams_table(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """The bucketed table; a session that did not build it learns of it here."""
    name = _table(folder)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} (g STRING, salt INT, text_id BIGINT, i INT) USING parquet "
                  f"CLUSTERED BY (g, salt) SORTED BY (g, salt) INTO {buckets} BUCKETS LOCATION '{folder}/grams'")
    return spark.table(name)


def _probes(ql: DataFrame, dictionary: DataFrame, gram: int) -> DataFrame:
    """(ql, g, o, need): the grams to look up, their offsets, and how many of them a start must have."""
    short = ql.where(F.length("ql").between(1, gram - 1))
    prefixes = dictionary.select("g", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(gram - 1)), lambda n: F.substring("g", F.lit(1), n))).alias("ql")) if gram > 1 else None
    grams = F.transform(F.sequence(F.lit(1), F.length("ql") - gram + 1),
                        lambda i: F.struct(F.substring("ql", i, F.lit(gram)).alias("g"), (i - 1).alias("o")))
    every = (ql.where(F.length("ql") >= gram).select("ql", F.explode(grams).alias("x")).select("ql", "x.g", "x.o")
             .join(dictionary, "g", "left"))
    rare = (every.groupBy("ql").agg(F.sort_array(F.collect_list(F.struct("f", "o", "g"))).alias("all"),
                                    F.count("f").alias("known"), F.count(F.lit(1)).alias("n"))
            .where(F.col("known") == F.col("n")).select("ql", F.slice("all", 1, PROBES).alias("best")))
    long = (rare.select("ql", F.size("best").alias("need"), F.explode("best").alias("b"))
            .select("ql", "b.g", "b.o", "need"))
    if prefixes is None:
        return long
    return long.unionByName(short.join(prefixes, "ql").select("ql", "g", F.lit(0).alias("o"), F.lit(1).alias("need")))


def candidates(spark: SparkSession, folder: str, ql: DataFrame) -> DataFrame:
    """(ql, text_id): texts in which all probes of a query stand at one start."""
    about = spark.read.parquet(f"{folder}/about").first()
    probes = _probes(ql, spark.read.parquet(f"{folder}/dictionary"), about["gram"])
    asked = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(about["salts"] - 1))))
    hits = asked.join(_grams_table(spark, folder, about["buckets"]), ["g", "salt"])
    start = F.when(F.col("need") > 1, F.col("i") - F.col("o")).otherwise(0)
    return (hits.groupBy("ql", "text_id", start.alias("start"), "need").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= F.col("need")).select("ql", "text_id").distinct())


def search_gram_index(spark: SparkSession, folder: str, queries: DataFrame,
                      max_results: int | None = None) -> DataFrame:
    """C12 over a stored index: ``(query_id, rank, product_id, name, price, category,
    description, url)`` for ``queries`` (query_id, query)."""
    about = spark.read.parquet(f"{folder}/about").first()
    k = about["k"] if max_results is None else max_results
    if k > about["k"]:
        raise ValueError(f"the index keeps {about['k']} names a text, {k} were asked for")
    q = queries.select("query_id", F.lower("query").alias("ql")).where(F.col("ql").isNotNull())
    ql = q.select("ql").distinct()
    texts = spark.read.parquet(f"{folder}/texts")
    found = (candidates(spark, folder, ql).join(as_large(texts), "text_id").where(F.col("text").contains(F.col("ql")))
             .select("ql", F.explode("firsts").alias("c")).select("ql", "c.product_id", "c.name"))
    rules = spark.read.parquet(f"{folder}/rules").collect()          # at most 5 rules x K rows
    top = _first_names(found.unionByName(rule_candidates(ql, "ql", rules)), ["ql"], k).withColumn(
        "rank", F.row_number().over(Window.partitionBy("ql").orderBy("product_id")))
    shown = spark.read.parquet(f"{folder}/products")
    return (q.join(top.select("ql", "rank", "product_id"), "ql").select("query_id", "rank", "product_id")
            .join(as_large(shown), "product_id").select("query_id", "rank", *COLUMNS))
