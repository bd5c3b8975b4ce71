"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text; white space and ASCII punctuation part words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunks import slices

SLICE_BYTES = 1_000_000
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), 95, *range(65, 91)]] = True
_IN_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words:
    """Words of some texts: ``hashes``, byte positions ``starts`` and ``ends`` in the
    lower-cased ``bytes`` of all texts, and ``offsets`` (text i has the words
    ``offsets[i]:offsets[i + 1]``)."""

    def __init__(self, texts: pa.Array):
        texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        self.bytes = (np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8))
        bounds = bounds - bounds[0]
        inside = np.zeros(len(self.bytes) + 1, bool)
        inside[:-1] = _IN_WORD[self.bytes]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = bounds[:-1][bounds[:-1] < len(self.bytes)]
        first[cut] = inside[cut]  # a text's first word is not the last one's tail
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[bounds[1:][bounds[1:] > 0] - 1] |= inside[bounds[1:][bounds[1:] > 0] - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, bounds)
        up, down = _powers_upto(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:len(self.bytes)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts]
                          + (self.ends - self.starts).astype(np.uint64))

    @classmethod
    def concat(cls, parts: list[Words]) -> Words:
        """One table of several, without their sums of powers: little memory."""
        out = cls.__new__(cls)
        byte = np.cumsum([0, *(len(w.bytes) for w in parts)])
        word = np.cumsum([0, *(len(w.hashes) for w in parts)])
        out.bytes = np.concatenate([np.zeros(0, np.uint8), *(w.bytes for w in parts)])
        out.hashes = np.concatenate([np.zeros(0, np.uint64), *(w.hashes for w in parts)])
        out.starts = np.concatenate([np.zeros(0, np.int64), *(w.starts + b for w, b in zip(parts, byte, strict=False))])
        out.ends = np.concatenate([np.zeros(0, np.int64), *(w.ends + b for w, b in zip(parts, byte, strict=False))])
        out.offsets = np.concatenate([[0], *(w.offsets[1:] + n for w, n in zip(parts, word, strict=False))])
        return out

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def word_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Slices of a batch of about ``size`` bytes of text (one row at least)."""
    for a, b in slices(texts, size):
        yield a, b, Words(texts.slice(a, b - a))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within a text, and the number of the text. A
    text with some words, but fewer than ``n``, has one: all of its words."""
    counts = words.counts()
    size = np.minimum(counts, n)
    per_text = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), per_text)
    ends = np.cumsum(per_text)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(words.offsets[:-1] - (ends - per_text), per_text)
    out = size[text].astype(np.uint64)
    for k in range(n):
        there = k < size[text] if (counts < n).any() else slice(None)
        out[there] = mix(out[there] * _BASE + words.hashes[(at[there] if there is not slice(None) else at) + k])
    return out, text
