"""Secret scans: fixed patterns, and character Markov models compared by
log-likelihood ratio.

Three fixed kinds (leftmost non-overlapping, a match that fails its length is
dropped): ``assign`` (a key word, a separator and a value of 12 or more
characters), ``access`` (AKIA and capitals or digits, 18 or more in all) and
``hex`` (16 or more lower-case hexadecimal digits). A fourth kind, ``random``, adds
runs of letters, digits, ``+``, ``/``, ``_`` and ``-`` of 16 or more characters that
no fixed kind covers and that look like random strings: they mix two of the three
classes upper, lower and digit, and the log-likelihood ratio of two character
Markov models reaches a margin a character. A run that fails as a whole is searched for
its best-scoring stretches of 16 or more characters; the best of many needs more, TRIES
times the logarithm of their number. They grow or shrink to the separators inside the
run. A run that a fixed span covers in part is judged whole, and what no fixed span
covers of its random stretches is added.

The models are trained from labelled samples.

* Ordinary identifiers: the class of a character (lower, upper, digit, separator) given
  the classes of the two before it, and a letter, without case, given the two before it in
  its part of the name (a part begins after a separator, a digit or where case rises),
  backing off to one and to none. Letters are counted over the words of all documents and,
  with equal weight, over the names in Python's own library; classes over those names.
* Random strings: an even mixture of the uniform model and of character pairs counted over
  the values that the fixed kinds find in all documents.

Counts of documents are two tables of fixed size from each task. The names are dealt into
three folds by crc32: the first trains, the second sets the margins (apart for runs with
and without a digit, such that at most FALSE_ALARM of its names are taken for random
strings), the third is held out for tests. Where the library's sources cannot be read, the
documents' words alone train, classes are uniform and the margin is MARGIN.

Defined cases: null text counts as empty; texts of any length are scanned whole;
repeated rows give repeated results; with no text at all nothing is added; other columns are kept where rows are
returned whole.
"""

from __future__ import annotations

import re
import sysconfig
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import give_back, slices

# The fixed kinds, as given.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE, MIN_ACCESS = 12, 18

RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
MIN_RUN = 16
SEPARATORS = "+/_-"
MARGIN = 1.0          # nats a character; where no names can set it
FALSE_ALARM = 0.005   # share of ordinary names
LEAST_MARGIN = 0.4    # names of other people's code are less like Python's
TRIES = 1.0
BACK_OFF = 8.0        # weight of the shorter context
PRIOR = 0.5           # of each pair
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
PLACEHOLDER = "[secret]"
SLICE_BYTES = 1_000_000

_CODE = np.zeros(256, np.int64)          # 0: any other character
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
STATES = len(ALPHABET) + 1
# 0: no letter of this part; 1 to 26: the letter in either case
_FOLD = np.zeros(256, np.int64)
for _c in range(26):
    _FOLD[[65 + _c, 97 + _c]] = _c + 1
FOLDED = 27
_CHARS = np.frombuffer(b"\0" + ALPHABET.encode(), np.uint8)
# 0: none yet; 1 lower, 2 upper, 3 digit, 4 separator
_CLASS = np.array([0] + [1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 for c in ALPHABET])
CLASSES = 5
_RISE = re.compile("(?<=[a-z])(?=[A-Z])")
# a name where Python defines or uses one, so that encoded data in string literals is not taken for names
_NAME = re.compile(r"(?:\b(?:def|class|import|self\.)\s*|^[ \t]*(?=\w+ = ))([A-Za-z][A-Za-z0-9_]{5,})", re.MULTILINE)
_HEXMARK = bytes(49 if chr(c) in "0123456789abcdef" else 48 for c in range(256))
_RUNMARK = bytes(49 if chr(c) in ALPHABET else 48 for c in range(256))
_HINTS = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed kinds, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"1" * 16 in text.encode("latin-1", "replace").translate(_HEXMARK):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _pairs(strings: list[str]) -> np.ndarray:
    """Counts of the character pairs inside the strings."""
    codes = _CODE[np.frombuffer("\n".join(strings).encode("latin-1", "replace"), np.uint8)]
    pair = codes[:-1] * STATES + codes[1:]
    counts = np.bincount(pair, minlength=STATES * STATES)
    table = counts.reshape(STATES, STATES).copy()
    table[0] = 0
    table[:, 0] = 0
    return table.ravel()


def _letter_triples(text: str) -> np.ndarray:
    """Counts of letters (without case) by the two before them in their word."""
    codes = np.concatenate([[0, 0], _FOLD[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]])
    one, two, now = codes[1:-1], codes[:-2], codes[2:]
    triple = (np.where(one > 0, two, 0) * FOLDED + one) * FOLDED + now
    return np.bincount(triple[now > 0], minlength=FOLDED ** 3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, pairs = np.zeros(FOLDED ** 3, np.int64), np.zeros(STATES * STATES, np.int64)
    for batch in batches:
        texts = batch.column("text")
        for first, end in slices(texts, SLICE_BYTES):
            secret: list[str] = []
            plain: list[str] = []
            for text in filter(None, texts.slice(first, end - first).to_pylist()):
                at = 0
                for a, b, kind in base_spans(text):
                    value = ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b]
                    secret += RUN.findall(value) or [value]
                    plain.append(text[at:a])
                    at = max(at, b)
                plain.append(text[at:])
            if secret:
                pairs += _pairs(secret)
            if plain:
                letters += _letter_triples("\n".join(plain))
    yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()),
                                      "counts": [letters.tolist(), pairs.tolist()]})


@lru_cache(maxsize=1)
def library_names() -> tuple[str, ...]:
    """The names of 6 or more characters in the sources of Python's own library, sorted."""
    names: set[str] = set()
    home = Path(sysconfig.get_paths()["stdlib"])
    for file in sorted(home.rglob("*.py")) if home.is_dir() else ():
        if "site-packages" not in file.parts:
            names.update(_NAME.findall(file.read_text("utf-8", "ignore")))
    return tuple(sorted(names))


def fold_of(name: str) -> int:
    """0: trains, 1: sets the margins, 2: held out."""
    return zlib.crc32(name.encode()) % 3


def _letters(counts: np.ndarray) -> np.ndarray:
    """Probability of a letter after two others, backing off to one and to none."""
    three = counts.reshape(FOLDED, FOLDED, FOLDED).astype(float)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p = (one + PRIOR) / (one.sum() + PRIOR * (FOLDED - 1))
    p = (two + BACK_OFF * p) / (two.sum(axis=1, keepdims=True) + BACK_OFF)
    return (three + BACK_OFF * p) / (three.sum(axis=2, keepdims=True) + BACK_OFF)


def _ordinary(letters: np.ndarray, names: list[str]) -> np.ndarray:
    """Log probability of a character after two others under the ordinary model."""
    sources = [letters] if letters.any() else []
    kinds = np.full((CLASSES, CLASSES, CLASSES), PRIOR)
    if names:
        sources.append(_letter_triples("\n".join(_RISE.sub("\n", n) for n in names)))
        for name in names:
            c = [0, 0, *_CLASS[_CODE[np.frombuffer(name.encode(), np.uint8)]].tolist()]
            np.add.at(kinds, (c[:-2], c[1:-1], c[2:]), 1)
    kinds[:, :, 0] = 0
    kinds /= kinds.sum(axis=2, keepdims=True)
    letter = np.mean([_letters(x) for x in sources or [letters]], axis=0)
    two, one, now = np.ix_(*[np.arange(STATES)] * 3)
    kind = kinds[_CLASS[two], _CLASS[one], _CLASS[now]]
    fold = _FOLD[_CHARS]
    new = (_CLASS[one] == 1) & (_CLASS[now] == 2)                 # case rises: a part begins
    before = np.where(new, 0, fold[one])
    first = np.where((before == 0) | ((_CLASS[two] == 1) & (_CLASS[one] == 2)), 0, fold[two])
    given = np.where(_CLASS[now] == 3, 0.1, np.where(_CLASS[now] == 4, 1 / len(SEPARATORS), letter[first, before, fold[now]]))
    given = np.where(_CLASS[now] == 0, 1.0, given)
    return np.log(np.maximum(kind, 1e-9)) + np.log(given)


def _random(pairs: np.ndarray) -> np.ndarray:
    """Log probability of a character after another under the random model."""
    table = pairs.reshape(STATES, STATES) + PRIOR
    table[:, 0] = 0
    single = table.sum(axis=0) / table.sum()
    table = (table + BACK_OFF * single) / (table.sum(axis=1, keepdims=True) + BACK_OFF)
    return np.log(0.5 * table + 0.5 / len(ALPHABET))


class Models(NamedTuple):
    """gains: log-likelihood ratio (random over ordinary) of a character after two others, flat;
    letters, digits: margins a character of stretches without and with a digit."""

    gains: np.ndarray
    letters: float
    digits: float


def fit(letters: np.ndarray, pairs: np.ndarray, names: Sequence[str]) -> Models:
    """The models of counted letters and pairs and of the names' first two folds."""
    ordinary = _ordinary(letters, [n for n in names if fold_of(n) == 0])
    gains = (_random(pairs)[None] - ordinary).astype(np.float32).ravel()
    if not letters.any():
        return Models(gains, np.inf, np.inf)
    runs = [n for n in names if fold_of(n) == 1 and len(n) >= MIN_RUN and _classes(n) >= 2]
    margins = []
    for digit in (False, True):
        group = [n for n in runs if any(c.isdigit() for c in n) == digit]
        low, high = LEAST_MARGIN, 8.0
        while group and high - low > 0.02:
            middle = (low + high) / 2
            models = Models(gains, middle, middle)
            if sum(bool(_stretches(n, models)) for n in group) <= FALSE_ALARM * len(group):
                high = middle
            else:
                low = middle
        margins.append(high if group else MARGIN)
    return Models(gains, *margins)


def train(docs: DataFrame) -> Models:
    """The models, their counts over all documents; tables of fixed size."""
    counts = (docs.select("text").mapInArrow(lambda it: give_back(_count(it)), "label int, counts array<bigint>")
              .select("label", F.posexplode("counts").alias("at", "n")).filter("n > 0")
              .groupBy("label", "at").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(FOLDED ** 3, np.int64), np.zeros(STATES * STATES, np.int64)
    for row in counts:
        total[row["label"]][row["at"]] = row["n"]
    return fit(*total, library_names())


def _classes(s: str) -> int:
    return any(c.isdigit() for c in s) + any("A" <= c <= "Z" for c in s) + any("a" <= c <= "z" for c in s)


def _gains(run: str, models: Models) -> np.ndarray:
    """Log-likelihood ratio of every character of the run."""
    codes = np.concatenate([[0, 0], _CODE[np.frombuffer(run.encode(), np.uint8)]])
    return models.gains[(codes[:-2] * STATES + codes[1:-1]) * STATES + codes[2:]].astype(float)


def _margin(s: str, models: Models) -> float:
    return models.digits if any(c.isdigit() for c in s) else models.letters


def _best_stretch(gain: np.ndarray) -> tuple[int, int, float] | None:
    """(start, end, sum) of the largest sum of gains over MIN_RUN or more characters, if positive."""
    if len(gain) < MIN_RUN:
        return None
    total = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.minimum.accumulate(total[:-MIN_RUN])
    end = int(np.argmax(total[MIN_RUN:] - low))
    best = float(total[end + MIN_RUN] - low[end])
    return (int(np.argmin(total[:end + 1])), end + MIN_RUN, best) if best > 0 else None


def _to_parts(run: str, a: int, b: int, low: int, high: int) -> tuple[int, int]:
    """The stretch with its end parts (between separators) whole if half or more of them
    lies in it, else without them."""
    def part(at):
        first = max(run.rfind(c, low, at) for c in SEPARATORS) + 1 or low
        after = [i for c in SEPARATORS if (i := run.find(c, at, high)) >= 0]
        return max(first, low), min(after, default=high)

    start, end = a, b
    first, after = part(a)
    if after < b:
        start = first if 2 * (after - a) >= after - first else after + 1
    elif 2 * (b - a) >= after - first:
        start = first
    first, after = part(b - 1)
    if first > a:
        end = after if 2 * (b - first) >= after - first else first - 1
    elif 2 * (b - a) >= after - first:
        end = after
    return (start, end) if end - start >= MIN_RUN else (min(a, start), max(b, end))


def _stretches(run: str, models: Models) -> list[tuple[int, int]]:
    """The parts of a run that look random: all of it, or the best-scoring stretches."""
    gains = _gains(run, models)
    if gains.mean() >= _margin(run, models):
        return [(0, len(run))] if _classes(run) >= 2 else []
    if gains.max() < min(models.letters, models.digits):
        return []
    out, open_ = [], [(0, len(run))]
    while open_:
        low, high = open_.pop()
        best = _best_stretch(gains[low:high] - min(models.letters, models.digits))
        if best is None:
            continue
        a, b = low + best[0], low + best[1]
        more = TRIES * np.log(1 + (high - low) - (b - a))          # the best of many stretches needs more
        if _classes(run[a:b]) >= 2 and gains[a:b].sum() >= (b - a) * _margin(run[a:b], models) + more:
            a, b = _to_parts(run, a, b, low, high)
            out.append((a, b))
        open_ += [(low, a), (b, high)]
    return out


def random_spans(text: str, models: Models, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Stretches of runs that the models take for random strings, without the spans already
    taken; a run is judged with them, so what is left of a longer token is found however short."""
    out = []
    if b"1" * 16 not in text.encode("latin-1", "replace").translate(_RUNMARK):
        return out
    for m in RUN.finditer(text):
        if _classes(m[0]) < 2:
            continue
        inside = [(a, b) for a, b, _ in taken if a < m.end() and m.start() < b]
        if any(a <= m.start() and m.end() <= b for a, b in inside):
            continue
        for a, b in _stretches(m[0], models):
            at, end = m.start() + a, m.start() + b
            for x, y in [*inside, (end, end)]:
                if at < min(x, end):
                    out.append((at, min(x, end), "random"))
                at = max(at, y)
    return sorted(out)


def all_spans(text: str, models: Models) -> tuple[list, list]:
    """(fixed spans, all spans); ``random`` sorts after the fixed kinds."""
    base = base_spans(text)
    more = random_spans(text, models, base)
    order = (*KINDS, "random")
    return base, sorted(base + more, key=lambda s: (s[0], order.index(s[2]))) if more else base


def find_spans(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, base and spans: array<struct<kind, start, end>> in code points, end exclusive."""
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    def scan(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        show = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        for batch in batches:
            found = [all_spans(t or "", models) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([show(b) for b, _ in found], kind),
                 pa.array([show(s) for _, s in found], kind)], ["doc_id", "base", "spans"])
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id bigint, base {span}, spans {span}")


def redact(docs: DataFrame, models: Models, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with every span replaced; overlapping spans become one placeholder.
    Texts without a span, null ones too, stay as they are."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    at = docs.columns.index("text")

    def clean(text):
        if not text:
            return text
        _, spans = all_spans(text, models)
        out, done = [], 0
        for a, b, _ in spans:
            if b <= done:
                continue
            if a >= done:
                out += [text[done:a], placeholder]
            done = b
        return "".join([*out, text[done:]]) if spans else text

    def scan(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return docs.mapInArrow(lambda it: give_back(scan(it)), schema)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    found = find_spans(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(shown("base"), 256).alias("base_sha256"),
                        shown("spans").alias("spans"))
