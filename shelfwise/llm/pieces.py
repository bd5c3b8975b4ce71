"""SentencePiece encoding and decoding with a distinct-chunk table.

In this model no piece has a space marker after another character, so pieces never
cross the marker that begins a word: a text's ids are the ids of its marked words
in order. Each distinct marked word of a batch is segmented once and the ids are
joined back by position. Texts in which markers stand together (two spaces, or one
at an end) may hold pieces of several markers; those are encoded whole. The
property is checked when the model is loaded; a model without it is refused.

Everything happens in the row's own task (no shuffle): memory is one slice of a
batch and a table of bounded size. Ids and decoded texts equal the library's
``encode`` and ``decode`` exactly.

Defined cases: null text counts as empty (no ids, empty decoded text); repeated
rows give repeated results; any length of text; an empty table gives an empty
result; other columns are kept unless they are called ``ids`` or ``decoded``, which
are replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkTable, encode_texts, give_back, slices


@functools.cache
def _processor(model: str):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model cross space markers: no distinct-chunk table")
    return sp


def _encode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    sp = _processor(model)
    table = ChunkTable(lambda chunks: sp.encode(chunks, num_threads=1))
    for batch in batches:
        texts = batch.column("text")
        for a, b in slices(texts):
            # the marker itself may stand in a text and then is one
            part = pc.replace_substring(texts.slice(a, b - a), "▁", " ")
            flat, counts = encode_texts(part, table, sp.encode)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            rows = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*rows.columns, ids], [*rows.schema.names, "ids"])


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    sp = _processor(model)
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        texts = pa.array((sp.decode(flat[a:b].tolist()) if b > a else ""
                          for a, b in zip(offsets[:-1], offsets[1:], strict=True)), pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])


def encode(df: DataFrame, model: str) -> DataFrame:
    """``df`` (with a column ``text``) and ``ids array<int>``."""
    df = df.drop("ids")
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(lambda it: give_back(_encode(it, model)), schema)


def decode(df: DataFrame, model: str) -> DataFrame:
    """``df`` (with a column ``ids``, no nulls) and ``decoded string``."""
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    return df.mapInArrow(lambda it: give_back(_decode(it, model)), schema)


def encode_and_decode(df: DataFrame, model: str) -> DataFrame:
    """Both at once, in one worker a task; the text itself is not kept."""
    df = df.drop("ids", "decoded")
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "text"),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return df.mapInArrow(lambda it: give_back(_decode(
        (b.drop_columns(["text"]) for b in _encode(it, model)), model)), schema)


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """The contract's columns per document, from the ids and the decoded text."""
    coded = encode_and_decode(docs.select("doc_id", "text"), model)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
