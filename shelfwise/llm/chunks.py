"""Distinct-chunk tables: split texts at single spaces, encode each distinct chunk
once per batch and join the ids back by position. Used where no token can cross a
space, so that a text's ids are its chunks' ids in order."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_CHARS = 1_500_000
TABLE_ENTRIES = 300_000


def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end, memory that was freed goes back to the system,
    for the worker stays and waits beside others."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chars`` bytes (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        upto = (ends[a - 1] if a else 0) + chars
        b = max(a + 1, int(np.searchsorted(ends, upto, "right")))
        yield a, b
        a = b


def take_ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[s:s+n]`` for every (s, n)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
    return flat[at]


class ChunkTable:
    """Ids of distinct chunks, kept over batches up to ``TABLE_ENTRIES`` entries and
    then begun anew, so memory is bounded whatever the vocabulary of the corpus."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """Row of every distinct chunk, encoding the new ones."""
        if len(self.row) > TABLE_ENTRIES:
            self.clear()
        new = [c for c in chunks if c not in self.row]
        if new:
            ids = self.encode(new)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            first = len(self.flat)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(lens.sum()))
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, first + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
        row = self.row
        return np.fromiter((row[c] for c in chunks), np.int64, len(chunks))


def encode_texts(texts: pa.Array, table: ChunkTable, whole: Callable[[str], list[int]] | None = None,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (nulls count as empty), flat, and the count of each text.

    ``whole``: encoder for the texts that have an empty chunk (a space at either
    end, or two together), where chunks may not stand alone; None if they always may.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.split_pattern(texts, " ")
    per_text = np.diff(split.offsets.to_numpy())
    coded = split.flatten().dictionary_encode()
    chunks = coded.dictionary.to_pylist()
    rows = table.rows(chunks)[coded.indices.to_numpy()]
    lens = table.lens[rows]
    flat = take_ragged(table.flat, table.starts[rows], lens)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    counts = np.bincount(text_of, weights=lens, minlength=len(texts)).astype(np.int64)
    if whole is not None and "" in chunks:
        odd = np.unique(text_of[coded.indices.to_numpy() == chunks.index("")])
        ends = np.cumsum(counts)
        parts, at = [], 0
        for i in odd.tolist():
            parts.append(flat[at:ends[i] - counts[i]])
            at = ends[i]
            parts.append(np.asarray(whole(texts[i].as_py()), np.int32))
            counts[i] = len(parts[-1])
        flat = np.concatenate([*parts, flat[at:]])
    return flat, counts
