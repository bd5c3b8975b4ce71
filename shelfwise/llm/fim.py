"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of about FRAME_BYTES bytes, each cut
at a unit's end, with the cumulative count of units and code points at every frame's
end. Units are ``[A-Za-z]+|[^A-Za-z]``. To place a cut after unit p, only the frame
that holds unit p is decompressed; a section of the text is then a list of frame
parts, and digests read those frames in the order of the output, one at a time.

Cuts and form follow from the SHA-256 of ``seed:doc_id`` alone (see :func:`choice`), so
a lost task gives the same rows again. Outputs: the text itself (plain),
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm). A text
that holds a mark stays plain, so the marks of an output are unambiguous and
:func:`restored` gives the text back exactly.

Defined cases: null text counts as empty (plain, no units); a null doc_id hashes as the
empty string; repeated rows give repeated results; texts of any length, frame by
frame; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import written

FRAME_BYTES = 16 << 10
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20   # percent: plain from h3 % 100 >= 90, spm below h4 % 100 < 20
MARKS = (b"<P>", b"<S>", b"<M>")
ORDER = {"psm": (b"<P>", b"<S>", b"<M>"), "spm": (b"<S>", b"<P>", b"<M>")}

FRAMES = ("doc_id bigint, marked boolean, frames array<binary>, frame_units array<bigint>, frame_chars array<bigint>")
DIGESTS = ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
           "output_sha256 string, restored_sha256 string, frames bigint, frames_opened bigint")


def unit_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which the units of UTF-8 ``data`` begin."""
    b = np.frombuffer(data, np.uint8)
    letter = ((b | 32) >= 97) & ((b | 32) <= 122)
    begins = (b & 0xC0) != 0x80        # not inside a character
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class Frames(NamedTuple):
    """A stored text: its frames, and units and code points up to each frame's end."""
    frames: list[bytes]
    units: list[int]
    chars: list[int]


def compress(data: bytes, frame_bytes: int = FRAME_BYTES) -> Frames:
    """``data`` in frames that end where a unit ends. A frame holds at least one unit,
    so a longer unit makes a longer frame."""
    packer = zstandard.ZstdCompressor(level=3)
    out = Frames([], [], [])
    starts = unit_starts(data)
    at = unit = chars = 0
    while at < len(data):
        upto = max(int(np.searchsorted(starts, at + frame_bytes, "right")) - 1, unit + 1)
        end = int(starts[upto]) if upto < len(starts) and at + frame_bytes < len(data) else len(data)
        upto = upto if end < len(data) else len(starts)
        part = data[at:end]
        at, unit, chars = end, upto, chars + code_points(part)
        out.frames.append(packer.compress(part))
        out.units.append(unit)
        out.chars.append(chars)
    return out


class Choice(NamedTuple):
    form: str
    prefix: int   # units
    middle: int   # units up to the middle's end


def choice(doc_id: int | None, n: int, marked: bool, seed: int = SEED) -> Choice:
    """Form and cuts of a text of ``n`` units."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or marked or h[2] % 100 >= PLAIN_FROM:
        return Choice("plain", a, b)
    return Choice("spm" if h[3] % 100 < SPM_BELOW else "psm", a, b)


class Reader:
    """Random access to a stored text; counts the frames it opens to place cuts."""

    def __init__(self, stored: Frames):
        self.stored = stored
        self.opener = zstandard.ZstdDecompressor()
        self.opened: dict[int, bytes] = {}

    def cut(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte offset in it, code points before) of the place after ``unit`` units."""
        units, chars = self.stored.units, self.stored.chars
        i = int(np.searchsorted(units, unit, "left"))  # the first frame that ends at the place or after it
        if not unit:
            return 0, 0, 0
        if units[i] == unit:
            return i + 1, 0, chars[i]
        if i not in self.opened:
            self.opened[i] = self.opener.decompress(self.stored.frames[i])
        data, first = self.opened[i], (units[i - 1] if i else 0)
        offset = int(unit_starts(data)[unit - first])
        return i, offset, (chars[i - 1] if i else 0) + code_points(data[:offset])

    def section(self, a: tuple, b: tuple) -> Iterator[bytes]:
        """The bytes between two cuts, frame by frame."""
        for i in range(a[0], min(b[0] + 1, len(self.stored.frames))):
            if i == b[0] and not b[1]:
                return
            data = self.opened.get(i) or self.opener.decompress(self.stored.frames[i])
            yield data[a[1] if i == a[0] else 0:b[1] if i == b[0] else len(data)]


def output(reader: Reader, chosen: Choice) -> tuple[Callable[[], Iterator[bytes]], int | None, int | None]:
    """(a function that streams the output, code points of the prefix, of the middle)."""
    start, end = (0, 0, 0), (len(reader.stored.frames), 0, 0)
    if chosen.form == "plain":
        return lambda: reader.section(start, end), None, None
    a, b = reader.cut(chosen.prefix), reader.cut(chosen.middle)
    parts = {b"<P>": (start, a), b"<S>": (b, end), b"<M>": (a, b)}

    def stream():
        for mark in ORDER[chosen.form]:
            yield mark
            yield from reader.section(*parts[mark])
    return stream, a[2], b[2] - a[2]


def _sections(parts: Iterator[bytes], marks: tuple[bytes, ...]) -> Iterator[tuple[bytes, bytes]]:
    """(mark, bytes after it) from a stream in which the marks stand once each, in order.
    The last two bytes are held back, for a mark may lie across two parts."""
    held, at = b"", -1
    for part in parts:
        held += part
        while at + 1 < len(marks) and (i := held.find(marks[at + 1])) >= 0:
            if at < 0 and i:
                raise ValueError("the output does not begin with its mark")
            if i:
                yield marks[at], held[:i]
            at, held = at + 1, held[i + 3:]
        if at >= 0 and len(held) > 2:
            yield marks[at], held[:-2]
            held = held[-2:]
    if at + 1 < len(marks):
        raise ValueError("the output lacks a mark")
    yield marks[at], held


def restored(parts: Iterator[bytes], form: str) -> Iterator[bytes]:
    """The text, streamed, from a streamed output and its form. What stands before its
    place in the output (the suffix) is held until the middle has gone out."""
    if form == "plain":
        yield from parts
        return
    kept: dict[bytes, list[bytes]] = {b"<P>": [], b"<S>": []}
    prefix_out = False
    for mark, data in _sections(parts, ORDER[form]):
        if mark != b"<M>":
            kept[mark].append(data)
            continue
        if not prefix_out:
            yield from kept[b"<P>"]
            prefix_out = True
        yield data
    yield from kept[b"<S>"]


def to_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The stored form of every text, written once to the shared folder."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows.append((any(m in data for m in MARKS), *compress(data, frame_bytes)))
            marked, frames, units, chars = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(marked, pa.bool_()), pa.array(frames, pa.list_(pa.binary())),
                 pa.array(units, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64()))],
                ["doc_id", "marked", "frames", "frame_units", "frame_chars"])
    return written(docs.select("doc_id", "text").mapInArrow(store, FRAMES), "fim-frames")


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[int | None, Reader, Choice]]:
    for i in range(batch.num_rows):
        value = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
        stored = Frames(value("frames"), value("frame_units"), value("frame_chars"))
        n = stored.units[-1] if stored.units else 0
        yield value("doc_id"), Reader(stored), choice(value("doc_id"), n, value("marked"))


def outputs(frames: DataFrame) -> DataFrame:
    """doc_id, form and the whole output of every stored text."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, c.form, b"".join(output(reader, c)[0]()).decode()) for doc_id, reader, c in _stored(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "form", "output"])
    return frames.mapInArrow(make, "doc_id bigint, form string, output string")


def _sha256(parts: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for part in parts:
        h.update(part)
    return h.hexdigest()


def digests(frames: DataFrame) -> DataFrame:
    """The contract's columns per stored text; ``frames`` it has and how many of them
    were opened to place its cuts (two at most)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, reader, c in _stored(batch):
                stream, prefix, middle = output(reader, c)
                units = reader.stored.units
                rows.append((doc_id, units[-1] if units else 0, c.form, prefix, middle, _sha256(stream()),
                             _sha256(restored(stream(), c.form)), len(units), len(reader.opened)))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)
    return frames.mapInArrow(read, DIGESTS)


def fim_digest(docs: DataFrame) -> DataFrame:
    return digests(to_frames(docs))
