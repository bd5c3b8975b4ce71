"""Toxicity: a bidirectional gated recurrent network over words and their characters
scores every overlapping window of a text; a text is as toxic as its worst window.

The network (gru.py) is trained here, in numpy, in one task, on a bounded sample of
labelled rows: at most MAX_POSITIVE and MAX_NEGATIVE of them, those with the
smallest hash of doc_id, with texts of at most MAX_CHARS characters. Training picks
windows as it goes, since labels are of whole texts. Scoring is a scan without a
shuffle; the model, a few megabytes whatever the corpus, is sent to the tasks.

Inputs are words (lower case) and character n-grams of the text only: never doc_id,
lang, source or any label. Held-out rows (crc32 of doc_id as text, modulo 3, is 1)
never reach training.

Defined cases: null text counts as empty, and empty texts get the score of a window
of no words; texts of any length are scored whole; repeated rows give repeated
results; of several labels of a doc_id the largest counts, null labels none; without
labels of both kinds every score is 0; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from .chunks import give_back
from .words import Words, word_slices

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 1_000, 2_000, 20_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
    rows.sort()
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) == 2:
        parts = [w for _, _, w in word_slices(pa.array([t for t, _ in rows], pa.large_string()))]
        yield pa.RecordBatch.from_pydict({"model": [gru.train(Words.concat(parts), labels).to_bytes()]})


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> bytes | None:
    """The trained model, or None without labels of both kinds."""
    marked = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .withColumn("h", F.xxhash64("doc_id")))
    pick = lambda y, n: marked.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(n)
    sample = pick(1, max_positive).unionAll(pick(0, max_negative))  # so many rows at most: may be broadcast
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id")
            .filter(F.length("text").between(1, MAX_CHARS))
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
            .select("text", "toxic").repartition(1))
    model = rows.mapInArrow(lambda it: give_back(_fit(it)), "model binary").collect()
    return bytes(model[0][0]) if model else None


def score(docs: DataFrame, model: bytes | None, column: str = "score") -> DataFrame:
    """``docs`` and a score between 0 and 1 per row; a column of that name is replaced."""
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = gru.Network.from_bytes(sent.value)
        for batch in batches:
            for a, b, words in word_slices(batch.column("text")):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(net.score(net.text_logits(words)), pa.float64())],
                                                 [*rows.schema.names, column])
    return docs.mapInArrow(lambda it: give_back(run(it)), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None,
               threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, all columns kept."""
    columns = docs.columns
    return (score(docs, train(docs if training_docs is None else training_docs, labels), "_score")
            .filter(F.col("_score") < threshold).select(*columns))
