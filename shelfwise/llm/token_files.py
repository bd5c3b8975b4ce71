"""Token ids in compressed shard files, with one shared dictionary.

A shard holds documents in ascending doc_id order::

    b"TOKS0001"  id width in bytes (u4)  sha256 of the dictionary (32 bytes)
    one zstandard frame per document (its ids, little-endian, of that width)
    index: per document doc_id i8, null flag u1, offset u8, length u4, tokens u4
    index offset u8, documents u8, b"TOKSEND1"

Frames are compressed one by one with a shared dictionary, so a short document is
read by two small range reads. The dictionary stands in its own file, named by its
hash, which every shard repeats.

Encoding: no token of this tokenizer crosses a space, so each distinct part of the
texts a worker sees is encoded once (WordEncoder).

Plan: documents are dealt out by ranges of doc_id (then a hash of the text, so rows
that share an id may be split), sorted in their task, encoded and written as they come. The shards' totals make a manifest from which
the starts follow; reading goes shard by shard. Shard names are unique to a task
attempt: a retried task never touches a file that the manifest names.

Defined cases: null text counts as empty (only the end id); null doc_id sorts
first; rows with one doc_id are ordered by a hash of the text, then by the text;
empty tables write no shard and read back no row; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import give_back, slices, take_ragged
from .common import open_file, put_file, put_stream, scratch, written

END_ID = 1
SAMPLE_DOCS = 2_000          # documents of which the dictionary is trained
SAMPLE_BYTES = 16_384        # of each of them at most
DICTIONARY_BYTES = 65_536
LEVEL = 3
SLICE_BYTES = 6_000_000
TABLE_ENTRIES = 600_000      # distinct strings whose ids a worker keeps
MAGIC, TAIL = b"TOKS0001", b"TOKSEND1"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4")])


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class _Table:
    """Ids of distinct strings, kept over the slices and tasks of a worker up to
    ``TABLE_ENTRIES`` of them and then begun anew, so memory is bounded."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.start, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their count for every one of the distinct strings."""
        at = pc.index_in(strings, value_set=self.known)
        if len(self.known) + at.null_count > TABLE_ENTRIES:
            self.clear()
            at = pc.index_in(strings, value_set=self.known)
        new = strings.filter(at.is_null())
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            at[at < 0] = len(self.known) + np.arange(len(new))
            ids, lens = self.encode(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lens) - lens])
            self.flat, self.lens = np.concatenate([self.flat, ids]), np.concatenate([self.lens, lens])
            self.known = pa.concat_arrays([self.known, new])
        return take_ragged(self.flat, self.start[at], self.lens[at]), self.lens[at]


class WordEncoder:
    """Ids of texts, each distinct part of them encoded once (see :class:`_Table`).

    This tokenizer drops white space and parts a text into runs of letters, single
    digits and runs of other characters; the last token of each part, and no other,
    ends in ``</w>``. So the distinct parts of many texts may be encoded as one text
    of lines and told apart again. That holds for chunks (between spaces) of plain
    characters: ASCII and Latin-1 letters, no apostrophe or ``<``, which have rules of
    their own. Other distinct chunks are encoded alone.
    """

    LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
    PLAIN = rf"\A[!-&(-;=-~{LETTERS[6:]}]*\z"
    PART = rf"([{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+)"

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.known_parts, self.known_chunks = _Table(self.lines), _Table(self.chunks)

    def lines(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their count for every one of the distinct parts (none empty)."""
        if not len(parts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        whole = "\n".join(parts.to_pylist())
        ids = np.array(self.tok.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts):
            raise ValueError("parts and word ends differ: not a tokenizer of this kind")
        return ids, np.diff(cuts, prepend=0)

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their count for every one of the distinct chunks."""
        plain = pc.match_substring_regex(chunks, self.PLAIN)
        parts = pc.split_pattern(pc.replace_substring_regex(chunks.filter(plain), self.PART, "\\1\n"), "\n")
        number = np.diff(parts.offsets.to_numpy())  # with the empty one after the last line feed
        coded = parts.flatten().dictionary_encode()
        known = coded.dictionary
        real = np.flatnonzero(pc.not_equal(known, "").to_numpy(zero_copy_only=False))
        flat, lens = self.known_parts(known.take(pa.array(real)))
        count = np.zeros(len(known), np.int64)
        count[real] = lens
        start = np.zeros(len(known), np.int64)
        start[real] = np.cumsum(lens) - lens
        part = coded.indices.to_numpy()
        ids = take_ragged(flat, start[part], count[part])
        of = np.repeat(np.arange(len(number)), number)
        total = np.bincount(of, weights=count[part], minlength=len(number)).astype(np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        odd = [e.ids for e in self.tok.encode_batch_fast(chunks.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        size = np.zeros(len(chunks), np.int64)
        size[mask], size[~mask] = total, [len(x) for x in odd]
        out = np.empty(int(size.sum()), np.int32)
        where = np.repeat(mask, size)
        out[where], out[~where] = ids, [i for x in odd for i in x]
        return out, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the count of each; nulls count as empty."""
        split = pc.split_pattern(_plain_case(texts), " ")
        per_text = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        flat, size = self.known_chunks(coded.dictionary)
        at = coded.indices.to_numpy()
        ids = take_ragged(flat, (np.cumsum(size) - size)[at], size[at])
        counts = np.bincount(np.repeat(np.arange(len(texts)), per_text), weights=size[at], minlength=len(texts))
        return ids, counts.astype(np.int64)


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """The worker's encoder, whose tables serve all its tasks."""
    return WordEncoder(path)


def _plain_case(texts: pa.Array) -> pa.Array:
    """Lower-case ASCII and line feeds as spaces, as the tokenizer has them: fewer
    distinct chunks. Not where ``<|`` might begin a special token's name."""
    # a copy of the slice: ascii_lower of pyarrow 23 misreads arrays that begin at an offset
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string()), pa.array([], pa.large_string())])
    simple = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
    return pc.if_else(pc.match_substring(texts, "<|"), texts, simple)


def _with_end(texts: pa.Array, encode: WordEncoder, end_id: int) -> list[np.ndarray]:
    flat, counts = encode(texts)
    ends = np.cumsum(counts)
    return [np.append(flat[e - n:e], np.int32(end_id)) for e, n in zip(ends, counts, strict=True)]


def _width(path: str) -> np.dtype:
    return np.dtype("<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary from SAMPLE_DOCS documents chosen by a hash of doc_id and
    text (a bounded sample), made in one task. Too few samples to train on:
    their own bytes serve as the dictionary."""
    import zstandard

    def train(batches):
        encode, kind, samples = _encoder(tokenizer), _width(tokenizer), []
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, SLICE_BYTES):
                samples += [x.astype(kind).tobytes()[:SAMPLE_BYTES]
                            for x in _with_end(texts.slice(a, b - a), encode, end_id)]
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            made = b"".join(samples)[-DICTIONARY_BYTES:]
        yield pa.RecordBatch.from_pydict({"dictionary": [made]})

    # about three times as many by their hash, whatever the number of tasks, then the smallest
    share = min(1.0, 3 * SAMPLE_DOCS / max(docs.count(), 1))
    sample = (docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
              .filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
              .orderBy("h", "text").limit(SAMPLE_DOCS).select("text").coalesce(1))
    rows = sample.mapInArrow(lambda it: give_back(train(it)), "dictionary binary").collect()
    return bytes(rows[0][0]) if rows else b""


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shards: int | None = None,
                 end_id: int = END_ID) -> DataFrame:
    """Write all documents; returns the manifest: shard, file, documents, tokens, bytes,
    start (ids before the shard)."""
    import zstandard

    spark = docs.sparkSession
    trained = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(trained).digest()
    spark.createDataFrame([(trained,)], "d binary").coalesce(1).foreachPartition(
        lambda rows: [put_file(folder, f"{digest.hex()}.dict", bytes(r[0])) for r in rows])
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, kind = _encoder(tokenizer), _width(tokenizer)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(trained))
        shard = TaskContext.get().partitionId()
        name, out, at, index, tokens = f"{shard:06d}-{uuid.uuid4().hex}.toks", None, 0, [], 0
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in slices(texts, SLICE_BYTES):
                if out is None:
                    out = put_stream(folder, name)
                    head = MAGIC + np.uint32(kind.itemsize).tobytes() + digest
                    out.write(head)
                    at = len(head)
                for key, ids in zip(keys[a:b], _with_end(texts.slice(a, b - a), encode, end_id), strict=True):
                    frame = press.compress(ids.astype(kind).tobytes())
                    out.write(frame)
                    index.append((key or 0, key is None, at, len(frame), len(ids)))
                    at += len(frame)
                    tokens += len(ids)
        if out is not None:
            rows = np.array(index, INDEX).tobytes()
            out.write(rows + np.array([at, len(index)], "<u8").tobytes() + TAIL)
            out.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "file": [name], "documents": [len(index)],
                "tokens": [tokens], "bytes": [at + len(rows) + 24]})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    made = (docs.select("doc_id", "text").repartitionByRange(shards, order[0], order[1])
            .sortWithinPartitions(*order)
            .mapInArrow(lambda it: give_back(write(it)), "shard int, file string, documents bigint, tokens bigint, bytes bigint"))
    manifest = written(made, "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("bigint")))


def _dictionary(raw: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _read_index(f) -> tuple[np.ndarray, bytes, np.dtype]:
    size = f.size()
    at, n = np.frombuffer(f.read_at(24, size - 24)[:16], "<u8").tolist()
    head = f.read_at(44, 0)
    if head[:8] != MAGIC:
        raise ValueError("not a token shard")
    return np.frombuffer(f.read_at(size - 24 - at, at), INDEX, n), head[12:44], np.dtype(f"<u{head[8]}")


def read_shards(manifest: DataFrame, folder: str, shards: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>) of every document, read from the files."""
    return _reader(manifest, folder, shards, "ids array<int>",
                   lambda x: x.astype(np.int32), pa.list_(pa.int32()))


def digest_shards(manifest: DataFrame, folder: str, shards: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    return _reader(manifest, folder, shards, "ids_crc32 bigint",
                   lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64())


def _reader(manifest, folder, shards, column, value, kind):
    import zstandard

    shards = shards or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = column.split()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[bytes, object] = {}
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(folder, row["file"]) as f:
                    index, digest, width = _read_index(f)
                    if digest not in dictionaries:
                        with open_file(folder, f"{digest.hex()}.dict") as d:
                            raw = d.read()
                        if hashlib.sha256(raw).digest() != digest:
                            raise ValueError(f"dictionary {digest.hex()} is damaged")
                        dictionaries[digest] = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
                    starts = row["start"] + np.cumsum(index["tokens"].astype(np.int64)) - index["tokens"]
                    for a in range(0, len(index), 512):
                        part = index[a:a + 512]
                        base = int(part["offset"][0])
                        block = f.read_at(int(part["offset"][-1] + part["length"][-1]) - base, base)
                        out = []
                        for o, n, k in zip(part["offset"].tolist(), part["length"].tolist(), part["tokens"].tolist(),
                                           strict=True):
                            ids = np.frombuffer(dictionaries[digest].decompress(block[o - base:o - base + n]), width)
                            if len(ids) != k:
                                raise ValueError(f"{row['file']}: {len(ids)} ids where the index has {k}")
                            out.append(value(ids))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(part["doc_id"].astype(np.int64), mask=part["null"].astype(bool)),
                            pa.array(starts[a:a + 512].astype(np.int64)), pa.array(part["tokens"].astype(np.int64)),
                            pa.array(out, kind)], ["doc_id", "start", "n_tokens", name])

    return (manifest.select("file", "start").repartition(shards)
            .mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {column}"))


def read_document(folder: str, file: str, at: int) -> np.ndarray:
    """Ids of document number ``at`` of one shard: its index and one frame are read."""
    import zstandard
    with open_file(folder, file) as f:
        index, digest, width = _read_index(f)
        with open_file(folder, f"{digest.hex()}.dict") as d:
            press = zstandard.ZstdDecompressor(dict_data=_dictionary(d.read()))
        row = index[at]
        return np.frombuffer(press.decompress(f.read_at(int(row["length"]), int(row["offset"]))), width)


def token_file_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to a new folder below the shared one and read them back."""
    folder = scratch(docs.sparkSession, "token-files")
    return digest_shards(write_shards(docs, tokenizer, folder), folder)
