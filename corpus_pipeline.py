"""A corpus pipeline of five operators: toxic documents go, one document of each
group of near copies stays, documents that hold benchmark passages go, secrets are
replaced in the texts, and the cleaned texts are encoded as word pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and reread as the next one's docs. All but the last return the columns of
``documents``, in their order, whatever other columns come with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import decontam, jaccard, pieces, secrets, toxicity
from shelfwise.llm.common import bounded_batches, table, written
from shelfwise.llm.queries import vocabulary
from shelfwise.session import ensure_checkpoint_dir, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents scored 0.7 or more go. The model learns from the labels of
    the documents that come in."""
    _ready(spark)
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each class of near copies, the document with the smallest doc_id stays."""
    _ready(spark)
    return jaccard.drop_near_copies(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that overlap a benchmark item go."""
    _ready(spark)
    return decontam.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: every secret is replaced; n_chars follows where a text changed."""
    _ready(spark)
    clean = secrets.redact(docs.select(*COLUMNS, F.col("text").alias("_before")), secrets.train(docs))
    same = F.col("text").eqNullSafe(F.col("_before"))
    return clean.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: doc_id, n_tokens, ids and decoded_ok (the ids decode to the text)."""
    _ready(spark)
    model = vocabulary("piece_bpe_32k.model")
    plain = F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" ")), 256)
    coded = pieces.encode_and_decode(docs.select("doc_id", "text", plain.alias("plain")), model)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        (F.sha2("decoded", 256) == F.col("plain")).alias("decoded_ok"))


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bounded_batches(spark)


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("sentencepiece", as_pieces),
]

# A trained network, a tokenizer and MinHash have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
