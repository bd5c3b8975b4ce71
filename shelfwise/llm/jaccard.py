"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

Texts are sets of their runs of five words (words.py); two texts are linked when
the Jaccard similarity of their sets is at least 0.8. Band and row counts follow
from the recall wanted at the threshold. Plan:

1. one scan makes each text's set key (a hash of its whole set), its size and its
   band hashes; nothing else is kept of it;
2. texts with equal sets become one class with a weight, before any comparison;
3. classes shuffle on band hashes; buckets of one are dropped. Buckets with the
   same members become one. A bucket over BLOCK members is cut into blocks, and
   each pair of blocks is a group of its own, so no task holds more than two
   blocks of one bucket however large the bucket is;
4. only the texts that share a bucket are read again; groups get their full sets
   and compare the pairs for which theirs is the first band in common, so a pair
   is verified once. A group returns, per member, the number of its links (with
   the weights of the partners) and the smallest member it is joined to: no pair
   ever becomes a row;
5. the joined members' components are the classes of the result.

Defined cases: a text of fewer than five words has one n-gram, all of its words; a
text without words (null, empty, only punctuation) is like no other and stands
alone; rows with one doc_id are separate documents; a class is named by its
smallest doc_id (null if it has none) and by class_key, which is never shared;
similarity exactly at the threshold links; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import give_back
from .common import written
from .components import components
from .words import grams, mix, word_slices

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 96
BLOCK = 256
COLUMNS = 4096  # of the membership matrix held at once


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest chance candidates, for
    which a pair at the threshold meets in some band with probability ``recall``."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes and bands <= 63:
            best = bands, rows
    if best is None:
        raise ValueError("no band count reaches this recall within max_hashes")
    return best


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return x[:n], x[n:] | np.uint64(1)


def locator() -> list[Column]:
    """128 bits that name a row by its id and text."""
    return [F.xxhash64("doc_id", "text").alias("l1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("l2")]


def _signatures(batches: Iterator[pa.RecordBatch], bands: int, rows: int, n: int) -> Iterator[pa.RecordBatch]:
    xors, factors = _constants(bands * rows)
    for batch in batches:
        texts = batch.column("text")
        for a, b, words in word_slices(texts):
            hashes, text = grams(words, n)
            ends = np.searchsorted(text, np.arange(b - a), "right")
            starts = np.concatenate([[0], ends[:-1]])
            some = np.flatnonzero(ends > starts)
            sets = [np.unique(hashes[s:e]) for s, e in zip(starts[some], ends[some], strict=True)]
            keys = np.full(b - a, None, object)
            keys[some] = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            sizes = np.zeros(b - a, np.int32)
            sizes[some] = [len(x) for x in sets]
            code = np.zeros((bands, len(some)), np.uint64)
            for k in range(bands * rows if len(some) else 0):
                least = np.minimum.reduceat((hashes ^ xors[k]) * factors[k], starts[some])
                band = k // rows
                code[band] = mix(code[band] * np.uint64(31) + least + np.uint64(band))
            lens = np.zeros(b - a, np.int32)
            lens[some] = bands
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            rest = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [rest.column("doc_id"), rest.column("l1"), rest.column("l2"), pa.array(keys, pa.binary()),
                 pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(code.T.ravel().view(np.int64)))],
                ["doc_id", "l1", "l2", "key", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b, words in word_slices(texts):
            hashes, text = grams(words, n)
            cut = np.searchsorted(text, np.arange(b - a + 1))
            sets = [np.unique(hashes[s:e]).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
            rest = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([rest.column("key"), pa.array(sets, pa.binary())], ["key", "grams"])


def _links(sets: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the wanted pairs (a boolean matrix, upper triangle) are similar enough."""
    size = np.array([len(s) for s in sets])
    wanted = wanted & (np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size))
    x, y = np.nonzero(wanted)
    if not len(x):
        return wanted
    if len(x) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                           for i, j in zip(x, y, strict=True)])
    else:
        used = np.unique(np.concatenate([x, y]))
        row = np.repeat(np.arange(len(used)), size[used])
        _, column, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
        shared = times > 1
        row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(used), len(used)), np.float32)
        for c in range(0, int(shared.sum()), COLUMNS):
            part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
            m = np.zeros((len(used), COLUMNS), np.float32)
            m[row[part], column[part] - c] = 1
            both += m @ m.T
        at = np.searchsorted(used, np.stack([x, y]))
        common = both[at[0], at[1]]
    near = common / (size[x] + size[y] - common) >= threshold
    out = np.zeros_like(wanted)
    out[x[near], y[near]] = True
    return out


def _compare(group: list[dict], threshold: float) -> list[tuple[bytes, int, bytes]]:
    """(key, links, smallest joined key) of the members of one group that have links."""
    group.sort(key=lambda r: r["key"])
    m = len(group)
    codes = np.array([r["bands"] for r in group])
    wanted = np.triu(np.ones((m, m), bool), 1)
    if group[0]["i"] != group[0]["j"]:
        block = np.array([r["block"] for r in group])
        wanted &= block[:, None] != block
    first = np.full((m, m), -1, np.int8)
    for band in range(codes.shape[1] - 1, -1, -1):
        first[codes[:, band][:, None] == codes[:, band]] = band
    mine = np.array([group[0]["mask"] >> k & 1 for k in range(codes.shape[1])] + [0], bool)
    near = _links([np.frombuffer(r["grams"], np.uint64) for r in group], wanted & mine[first], threshold)
    near |= near.T
    weight = np.array([r["weight"] for r in group])
    links, root = near @ weight, np.arange(m)
    while True:
        least = np.minimum(root, np.where(near, root, m).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return [(group[k]["key"], int(links[k]), group[root[k]]["key"]) for k in np.flatnonzero(near.any(axis=1))]


def _groups(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; one group is held at a time."""
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    group: list[dict] = []
    at = None
    out: list[tuple] = []
    for batch in batches:
        ids = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")), strict=True))
        k = 0
        while k < len(ids):
            end = k
            while end < len(ids) and ids[end] == ids[k]:
                end += 1
            if ids[k] != at:
                out += _compare(group, threshold) if len(group) > 1 else []
                group, at = [], ids[k]
            group += batch.slice(k, end - k).to_pylist()
            k = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
    out = _compare(group, threshold) if len(group) > 1 else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL,
                    block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (other documents it is similar
    to), class_key, and keep: whether it stands for its class (the smallest doc_id;
    rows that repeat its id and text too, in which l1 and l2 name the row)."""
    bands, rows = bands_and_rows(threshold, recall)
    signed = written(docs.select("doc_id", "text", *locator()).mapInArrow(
        lambda it: give_back(_signatures(it, bands, rows, n)),
        "doc_id bigint, l1 bigint, l2 bigint, key binary, size int, bands array<bigint>"), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "l1", "l2")
    classes = written(signed.filter("key is not null").groupBy("key").agg(
        F.min(place).alias("place"), F.count(F.lit(1)).alias("weight"), F.any_value("bands").alias("bands")), "sets")

    in_bucket = classes.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = written(in_bucket.join(shared, "bucket"), "buckets")
    small = (members.filter(F.col("members") <= block).groupBy("bucket", "band")
             .agg(F.sort_array(F.collect_list("key")).alias("keys"))
             .groupBy("keys").agg(F.min("bucket").alias("bucket"),
                                  F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
             .select("bucket", "mask", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"),
                     F.explode("keys").alias("key")))
    blocks = F.ceil(F.col("members") / block).cast("int")
    large = (members.filter(F.col("members") > block)
             .withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("bucket", F.expr("shiftleft(1L, band)").alias("mask"), F.least("block", "other").alias("i"),
                     F.greatest("block", "other").alias("j"), "block", "key"))
    grouped = small.unionAll(large)

    again = (docs.select("text", *locator())
             .join(classes.join(members.select("key").distinct(), "key", "left_semi")
                   .select("key", F.col("place.l1").alias("l1"), F.col("place.l2").alias("l2")), ["l1", "l2"])
             .select("key", "text"))
    sets = again.mapInArrow(lambda it: give_back(_sets(it, n)), "key binary, grams binary").groupBy("key").agg(
        F.any_value("grams").alias("grams"))
    full = sets.join(classes.select("key", "weight", "bands"), "key")
    found = written(grouped.join(full, "key").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
                    .mapInArrow(lambda it: give_back(_groups(it, threshold)), "key binary, links bigint, root binary"), "links")

    joined = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    labelled = (classes.select("key", "place", "weight").join(links, "key", "left")
                .join(joined.withColumnRenamed("node", "key"), "key", "left")
                .withColumn("component", F.coalesce("component", "key")))
    names = labelled.groupBy("component").agg(F.min("place").alias("first"))
    by_key = labelled.join(names, "component").select(
        "key", "component", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", "l1", "l2", "key").join(by_key, "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        F.when(alone, F.concat(F.lit("empty-"), F.hex("l1"), F.hex("l2"))).otherwise(F.lower(F.hex("component"))).alias("class_key"),
        (alone | ((F.col("first.l1") == F.col("l1")) & (F.col("first.l2") == F.col("l2")))).alias("keep"), "l1", "l2")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stand for their class, one row each, all columns kept."""
    kept = jaccard_classes(docs, **options).filter("keep").select("l1", "l2")
    one, two = locator()
    at = ["_l1", "_l2"]
    return (docs.withColumn(at[0], one).withColumn(at[1], two)
            .join(kept.toDF(*at), at, "left_semi").dropDuplicates(at).drop(*at))
