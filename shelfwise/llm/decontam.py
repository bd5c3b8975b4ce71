"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over word positions; positions marked 0 are ignored, so a hash of
the words under a mask survives substitutions there. The masks below are lossless:
any WINDOW words that differ from a benchmark item in at most MISMATCHES places
share a seed with it under one of the masks (a test enumerates all cases).

A document overlaps an item when some WINDOW of its words, aligned without gaps,
equals the item's in all but MISMATCHES places. Shorter items are looked for whole,
with fewer substitutions and lossless masks of their own: 10 to 12 words with two, 8
and 9 with one, SHORTEST to 7 exactly. Still shorter ones are not looked for (chance
would find them anywhere).

Plan: the seeds of the items set bits of a table of fixed size, whatever the number
of items; one scan of the documents hashes all seeds and keeps the few positions
whose bits are set, as regions (neighbouring hits with the words around them). Seed
hits then meet the items' seeds by a join on the hash, hits of one alignment become
one row, and alignments are verified on the region's words. No document text is
shuffled; a passage that a third of the documents share makes rows in proportion to
them, and its join key can be split by the engine.

Defined cases: null texts count as empty; empty texts have no overlap; a null
item_id is an item of its own; items with equal texts are found each; several
overlaps of a document and an item become one row with the longest; repeated rows
become one (distinct doc_id); an empty benchmark or table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import give_back
from .common import written
from .words import Words, mix, word_slices

MASKS = ("111011", "110111", "1100001011")
WINDOW, MISMATCHES = 13, 3
SHORTEST = 5
# For items shorter than WINDOW: (least words, substitutions, masks), longest first.
SHORT_ITEMS = ((10, 2, ("11111", "111011", "11010011")), (8, 1, ("11111", "111011")))
SLOTS = 1 << 22              # bits of the filter: half a megabyte
MARGIN = 64                  # words kept on either side of a region's hits


def item_masks(n: int) -> tuple[str, ...]:
    """The masks for an item of n words."""
    if n >= WINDOW:
        return MASKS
    if n < SHORTEST:
        return ()
    return next((masks for least, _, masks in SHORT_ITEMS if n >= least), ("1" * n,))


def tolerance(n: int) -> tuple[int, int]:
    """(words, substitutions allowed in so many words) for an item of n words."""
    if n >= WINDOW:
        return WINDOW, MISMATCHES
    return n, next((allowed for least, allowed, _ in SHORT_ITEMS if n >= least), 0)


def _seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask at every position where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, hash_of_name(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n]
    return mix(out)


def hash_of_name(mask: str) -> np.uint64:
    return mix(np.array([int("1" + mask, 2)], np.uint64))[0]


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((hashes >> np.uint64(8)) % np.uint64(SLOTS)).astype(np.int64), (
        (hashes >> np.uint64(34)) % np.uint64(SLOTS)).astype(np.int64)


def item_seeds(items: DataFrame) -> DataFrame:
    """item (a number of the row's own), item_id, words (array<bigint>), seeds
    (array<struct<hash, at>>) and the masks under which the item was hashed."""
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
        for batch in batches:
            out: dict[str, list] = {"words": [], "seeds": [], "masks": []}
            for a, b, words in word_slices(batch.column("text")):
                for i in range(b - a):
                    own = words.hashes[words.offsets[i]:words.offsets[i + 1]]
                    masks = item_masks(len(own))
                    found = [(m, _seed_hashes(own, m)) for m in masks]
                    out["words"].append(own.view(np.int64))
                    out["seeds"].append([{"hash": h, "at": k} for _, x in found
                                         for k, h in enumerate(x.view(np.int64).tolist())])
                    out["masks"].append(list(masks))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("item_id"), pa.array(out["words"], pa.list_(pa.int64())),
                 pa.array(out["seeds"], kind), pa.array(out["masks"], pa.list_(pa.string()))],
                ["item", "item_id", "words", "seeds", "masks"])
    rows = items.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("bigint"), "text").distinct()
    return rows.mapInArrow(seeds, "item bigint, item_id bigint, words array<bigint>, "
                           "seeds array<struct<hash:bigint,at:int>>, masks array<string>")


def _filter(seeds: DataFrame) -> tuple[np.ndarray, list[str]]:
    """The bit table of all seeds (SLOTS bits, whatever their number) and the masks in use."""
    hashes = seeds.select(F.explode("seeds.hash").alias("h"))
    word = lambda shift: F.expr(f"pmod(shiftrightunsigned(h, {shift}), {SLOTS})")
    slots = hashes.select(F.explode(F.array(word(8), word(34))).alias("slot"))
    packed = (slots.select((F.col("slot") / 64).cast("int").alias("at"),
                           F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
              .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect())  # SLOTS / 64 rows at most
    table = np.zeros(SLOTS // 64, np.int64)
    for row in packed:
        table[row["at"]] = row["bits"]
    bits = np.unpackbits(table.astype("<i8").view(np.uint8), bitorder="little")
    masks = [r[0] for r in seeds.select(F.explode("masks").alias("m")).distinct().collect()]  # a few names
    return np.packbits(bits), sorted(masks, key=lambda m: (len(m), m))


def _regions(batches: Iterator[pa.RecordBatch], packed: np.ndarray, masks: list[str]) -> Iterator[pa.RecordBatch]:
    bits = np.unpackbits(packed).astype(bool)
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
    for batch in batches:
        for a, b, words in word_slices(batch.column("text")):
            at, hashes = _hits(words, masks, bits)
            if not len(at):
                continue
            text = np.searchsorted(words.offsets, at, "right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (text[1:] != text[:-1]) | (at[1:] - at[:-1] > MARGIN)
            cut = np.append(np.flatnonzero(new), len(at))
            ids, out = batch.column("doc_id").slice(a, b - a), ([], [], [], [])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                t = text[s]
                first = max(words.offsets[t], at[s] - MARGIN)
                last = min(words.offsets[t + 1], at[e - 1] + MARGIN + WINDOW)
                out[0].append(t)
                out[1].append(first - words.offsets[t])
                out[2].append(words.hashes[first:last].view(np.int64))
                out[3].append([{"hash": h, "at": k} for h, k in zip(
                    hashes[s:e].view(np.int64).tolist(), (at[s:e] - first).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out[0])), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())),
                 pa.array(out[3], kind)], ["doc_id", "first", "words", "hits"])


def _hits(words: Words, masks: list[str], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of all seeds whose bits are set, by position; none crosses texts."""
    found_at, found = [], []
    ends = words.offsets[1:]
    for mask in masks:
        h = _seed_hashes(words.hashes, mask)
        one, two = _slots(h)
        at = np.flatnonzero(bits[one])
        at = at[bits[two[at]]]
        at = at[at + len(mask) <= ends[np.searchsorted(words.offsets, at, "right") - 1]]
        found_at.append(at)
        found.append(h[at])
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = np.concatenate(found_at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    return at[order], hashes[order]


def longest_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first, end, equal words) in ``doc`` of the longest stretch in which every
    window of an item aligned at ``doc[k] ~ item[k - diagonal]`` has no more differences
    than its length allows; None if there is none."""
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    width, allowed = tolerance(len(item))
    if hi - lo < width:
        return None
    same = doc[lo:hi] == item[lo - diagonal:hi - diagonal]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= width - allowed)
    if not len(good):
        return None
    runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    run = max(runs, key=len)
    first, end = int(run[0]), int(run[-1]) + width
    inside = np.flatnonzero(same[first:end])
    first, end = first + int(inside[0]), first + int(inside[-1]) + 1
    return lo + first, lo + end, int(same[first:end].sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, items = batch.column("words"), batch.column("item_words")
        diagonals, firsts = batch.column("diagonal").to_pylist(), batch.column("first").to_pylist()
        keep, out = [], []
        for k in range(batch.num_rows):
            got = longest_overlap(docs[k].values.to_numpy(), items[k].values.to_numpy(), diagonals[k])
            if got:
                keep.append(k)
                out.append((got[0] + firsts[k], got[1] + firsts[k], got[2]))
        if keep:
            rows = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("item_id"),
                 *(pa.array([o[i] for o in out], pa.int64()) for i in range(3))],
                ["doc_id", "item_id", "first_word", "end_word", "equal_words"])


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, first_word,
    end_word (of the document, end exclusive) and equal_words of the longest overlap."""
    seeds = written(item_seeds(items), "item-seeds")
    packed, masks = _filter(seeds)
    regions = written(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        lambda it: give_back(_regions(it, packed, masks)), "doc_id bigint, first bigint, words array<bigint>, "
        "hits array<struct<hash:bigint,at:int>>").withColumn("region", F.xxhash64("doc_id", "first", "words")), "regions")
    hit = regions.select("region", F.explode("hits").alias("h")).select("region", "h.hash", "h.at")
    seed = seeds.select("item", F.explode("seeds").alias("s")).select(
        "item", F.col("s.hash").alias("hash"), F.col("s.at").alias("item_at"))
    aligned = (hit.join(seed, "hash").select("region", "item", (F.col("at") - F.col("item_at")).alias("diagonal"))
               .distinct())
    both = (aligned.join(regions.select("region", "doc_id", "first", "words").distinct(), "region")
            .join(seeds.select("item", "item_id", F.col("words").alias("item_words")), "item")
            .select("doc_id", "item_id", "first", "diagonal", "words", "item_words"))
    found = both.mapInArrow(_verify, "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, equal_words bigint")
    best = F.max(F.struct("equal_words", (-F.col("first_word")).alias("f"), (-F.col("end_word")).alias("e")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.f")).alias("first_word"), (-F.col("b.e")).alias("end_word"), "b.equal_words")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that overlap no item; rows are told apart by id and text, so a
    null doc_id is no hiding place."""
    row = F.xxhash64("doc_id", "text")
    found = overlaps(docs.select(row.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_row")).distinct()
    return docs.withColumn("_row", row).join(found, "_row", "left_anti").drop("_row")
