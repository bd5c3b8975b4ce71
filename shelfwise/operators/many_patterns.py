"""Field extraction with many patterns as data.

``functions/extract.py`` compiles a short pattern table into the plan, which grows with
every pattern. Here the patterns are rows of a DataFrame (``ord, field_name, regex,
priority, keywords``; other columns are ignored, see :func:`check_patterns`):

    patterns, by (priority, ord) --parts of PART_BYTES--> broadcast
    rows --one pass per part (mapInArrow)--> + candidates (ord, field, regex) of the row
    values of the candidates by Java's regex engine, in the row

A part's keywords form one automaton a worker builds once, so finding a row's
candidates takes one scan of its query whatever the number of patterns; only the
candidates' regexes run, and a search by priority ends with the first that matches.
A plain regex (see _PLAIN: it begins with a word, and where it matches does not depend on
the engine) can only match where its word stands. A second automaton finds those places
of a text in one scan, a candidate that matches at none of them is dropped, and Java gets
the first match in place of the text; other regexes are searched in the whole text.
Nothing is shuffled and nothing is joined, so a hot keyword or a repeated row is no key.
The plan has one node a part, not one a pattern.

The values are those of ``extract_field``, ``extract_all_fields`` (of the patterns
whose keyword the query holds) and ``fuzzy_extract_field`` with the same patterns in
one table. Defined cases: a null query has no candidates; a null text no value; a
pattern without keywords is never a candidate, one with an empty keyword always is (of
a query that is not null); a null regex never matches; rows are kept as they are, repeated
ones too; no patterns give no values.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FUZZY_THRESHOLD
from ..functions.extract import _FLAGS
from ..functions.text import strip, whitespace_words

PART_BYTES = 16 << 20          # of patterns in one broadcast and one automaton
_BATCH_BYTES = 8 << 20         # of rows sent to a worker at once
_CANDIDATE_BYTES = 16 << 20    # of candidates handed back at once, but for a row with more
_KEPT = 4                      # automatons a worker keeps

_CANDIDATE = "array<struct<ord:bigint,field:string,regex:string,confidence:double,found:string>>"
_FIELDS = ["ord", "field", "regex", "confidence", "found"]

# A lower-case word, then literals, classes and groups without alternatives, assertions or quantifiers of groups.
_PLAIN = re.compile(r"([a-z0-9]{2,})(?:(?:\[\^?(?:a-z|A-Z|0-9|[A-Za-z0-9 _.,:;])+\]|[A-Za-z0-9 _,:;])(?:[*+?]\??)?|\((?!\?)|\)(?![*+?{]))*")
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")  # beyond ASCII, equal to i, s or k under (?iu)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_COMPILED = 20_000             # plain regexes a worker keeps compiled


def check_patterns(patterns: DataFrame) -> None:
    """Raise ``ValueError`` for a null or repeated ``ord``, or a regex that the engine
    cannot compile or that has no group 1 (one job over the pattern table)."""
    row = patterns.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("distinct")).first()
    if row["n"] != row["distinct"]:
        raise ValueError("every pattern needs an ord of its own")
    # the empty alternative matches, so the engine looks up group 1 too
    tried = F.call_function("regexp_extract", F.lit(""), F.concat(F.lit(f"{_FLAGS}(?:"), "regex", F.lit(")|")), F.lit(1))
    try:
        patterns.agg(F.max(F.length(tried))).collect()
    except Exception as e:
        raise ValueError("not a pattern with a group for this engine") from e


def _parts(patterns: DataFrame, part_bytes: int) -> Iterator[list[tuple]]:
    """The pattern rows by priority, in runs of about ``part_bytes``."""
    part, size = [], 0
    rows = patterns.select(F.col("ord").cast("long").alias("ord"), "field_name", "regex", "keywords", "priority")
    for r in rows.orderBy("priority", "ord").toLocalIterator():
        part.append((r["ord"], r["field_name"], r["regex"], tuple(r["keywords"] or ())))
        size += 64 + sum(len(x or "") for x in (r["field_name"], r["regex"], *part[-1][3]))
        if size >= part_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Keywords:
    """Pattern numbers of a part by the keywords that a lower-cased query holds."""

    def __init__(self, rows: list[tuple], _threshold):
        patterns_of: dict[str, list[int]] = {}
        for at, (*_, keywords) in enumerate(rows):
            for k in dict.fromkeys(k for k in keywords if k is not None):
                patterns_of.setdefault(k, []).append(at)
        self.always = patterns_of.pop("", [])
        self.patterns_of = list(patterns_of.values())
        self.automaton = ahocorasick.Automaton()
        for number, keyword in enumerate(patterns_of):
            self.automaton.add_word(keyword, number)
        if patterns_of:
            self.automaton.make_automaton()

    def __call__(self, query: str) -> tuple[list[int], list[float] | None]:
        found = set(self.always)
        if self.patterns_of:
            for number in {number for _, number in self.automaton.iter(query)}:
                found.update(self.patterns_of[number])
        return sorted(found), None


class _Similar:
    """Pattern numbers of a part whose keywords have a Jaccard similarity of ``threshold``
    with the query's distinct words, and the similarities."""

    def __init__(self, rows: list[tuple], threshold: float):
        self.patterns_of: dict[str, list[int]] = {}
        self.sizes, self.threshold = [], threshold
        for at, (*_, keywords) in enumerate(rows):
            distinct = dict.fromkeys(k for k in keywords if k is not None)
            self.sizes.append(len(distinct))
            for k in distinct:
                self.patterns_of.setdefault(k, []).append(at)

    def __call__(self, words: list[str]) -> tuple[list[int], list[float]]:
        shared: dict[int, int] = {}
        for w in words:
            for at in self.patterns_of.get(w, ()):
                shared[at] = shared.get(at, 0) + 1
        found = [(at, n / (len(words) + self.sizes[at] - n)) for at, n in sorted(shared.items())]
        found = [x for x in found if x[1] >= self.threshold]
        return [at for at, _ in found], [similarity for _, similarity in found]


@functools.lru_cache(_COMPILED)
def _compiled(regex: str) -> re.Pattern | None:
    """A plain regex over texts without a character of _FOLDED; None if it is left to Java's engine."""
    try:
        made = re.compile(regex, re.IGNORECASE | re.ASCII)
    except re.error:
        return None
    return made if made.groups else None


class _Places:
    """First matches of a part's plain regexes, tried where their words stand in a text."""

    def __init__(self, rows: list[tuple]):
        self.regexes = [r[2] for r in rows]
        self.automaton, number_of = ahocorasick.Automaton(), {}
        self.word_of = []
        for regex in self.regexes:
            plain = regex and _PLAIN.fullmatch(regex)
            self.word_of.append(number_of.setdefault(plain[1], len(number_of)) if plain else None)
        for word, number in number_of.items():
            self.automaton.add_word(word, (number, len(word) - 1))
        if number_of:
            self.automaton.make_automaton()
        self.any = bool(number_of)

    def __call__(self, text: str | None, ats: list[int], scores: list[float] | None, upto_first: bool = False) -> tuple[list, list | None, list]:
        """The candidates that may match, or those up to the first that does, their scores and first matches (None: not known)."""
        if not self.any or not ats or text is None or _FOLDED.search(text):
            return ats, scores, [None] * len(ats)
        starts: dict[int, list[int]] = {}
        for end, (number, before) in self.automaton.iter(text.lower() if text.isascii() else text.translate(_LOWER)):
            starts.setdefault(number, []).append(end - before)
        kept, firsts = [], []
        for i, at in enumerate(ats):
            first, pattern = None, None if self.word_of[at] is None else _compiled(self.regexes[at])
            if pattern is not None:
                first = next((m.group() for m in (pattern.match(text, s) for s in starts.get(self.word_of[at], ())) if m), None)
                if first is None:
                    continue
            kept.append(i)
            firsts.append(first)
            if upto_first and first is not None:
                break
        return [ats[i] for i in kept], None if scores is None else [scores[i] for i in kept], firsts


_BUILT: dict[str, tuple] = {}


def _built(name: str, part, kind: type, threshold):
    """The finder and the places of a broadcast part, its rows as arrays and their sizes; kept by the worker."""
    if name not in _BUILT:
        while len(_BUILT) >= _KEPT:
            _BUILT.pop(next(iter(_BUILT)))
        rows = part.value
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                   pa.array([None if r[2] is None else _FLAGS + r[2] for r in rows], pa.string())]
        sizes = np.array([32 + len(r[1] or "") + len(r[2] or "") for r in rows])
        _BUILT[name] = kind(rows, threshold), _Places(rows), columns, sizes
    return _BUILT[name]


def _lists(found: list, columns: list) -> pa.Array:
    """One list of candidates a row."""
    offsets = np.cumsum([0, *(len(ats) for ats, *_ in found)])
    ats = pa.array([at for ats, *_ in found for at in ats], pa.int64())
    scores = pa.array([s for ats, x, _ in found for s in (x if x is not None else [None] * len(ats))], pa.float64())
    firsts = pa.array([m for *_, x in found for m in x], pa.string())
    values = pa.StructArray.from_arrays([*(c.take(ats) for c in columns), scores, firsts], _FIELDS)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _find(part, kind: type, threshold, query: str, text: str | None, upto_first: bool, out: str) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, places, columns, sizes = _built(out, part, kind, threshold)  # the column's name is unique
        for batch in batches:
            queries, texts = batch.column(query), None if text is None else batch.column(text)
            found, size, start = [], 0, 0

            def rows(end):
                some = batch.slice(start, end - start)  # noqa: B023
                return pa.RecordBatch.from_arrays([*some.columns, _lists(found, columns)], [*batch.schema.names, out])  # noqa: B023
            for i in range(batch.num_rows):
                value = queries[i].as_py()
                ats, scores = ([], None) if value is None else finder(value)
                found.append(places(texts[i].as_py() if texts is not None and ats else None, ats, scores, upto_first))
                size += int(sizes[found[-1][0]].sum()) + sum(len(m or "") for m in found[-1][2])
                if size >= _CANDIDATE_BYTES:
                    yield rows(i + 1)
                    found, size, start = [], 0, i + 1
            if found:
                yield rows(batch.num_rows)
    return find


def _with_candidates(df: DataFrame, query: Column, text_col: str, patterns: DataFrame, kind: type, threshold,
                     part_bytes: int, upto_first: bool = False) -> tuple[DataFrame, str]:
    """``df`` and one more column: every row's candidates, by priority and ord (``upto_first``: those after
    one that is known to match may be left out)."""
    text = text_col if dict(df.dtypes).get(text_col) == "string" else None
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    name = f"c{uuid.uuid4().hex}"
    own = [F.col(f"`{c}`") for c in df.columns]
    rows, parts = df.select(*own, query.alias(f"{name}_q")), []
    for part in _parts(patterns, part_bytes):
        parts.append(f"{name}_{len(parts)}")
        schema = T.StructType([*rows.schema.fields, T.StructField(parts[-1], T._parse_datatype_string(_CANDIDATE))])
        rows = rows.mapInArrow(_find(spark.sparkContext.broadcast(part), kind, threshold, f"{name}_q", text, upto_first, parts[-1]), schema)
    found = F.concat(*parts) if parts else F.array().cast(_CANDIDATE)
    return rows.select(*own, found.alias(name)), name


def _value(text: Column, candidate: Column) -> Column:
    """Group 1 of the first match, stripped; null when nothing matches."""
    regex, found = candidate["regex"], candidate["found"]
    group1 = lambda x: strip(F.call_function("regexp_extract", x, regex, F.lit(1)))
    return F.when(found.isNotNull(), group1(found)).when(F.regexp_like(text, regex), group1(text))


def _first(text: Column, candidates: Column) -> Column:
    """(value, confidence) of the first candidate that matches; the others do not run."""
    kind = "struct<value:string,confidence:double>"

    def step(found, c):
        value = _value(text, c)
        return F.coalesce(found, F.transform(F.array(value), lambda v: F.when(  # binds the value once
            v.isNotNull(), F.struct(v.alias("value"), c["confidence"].alias("confidence"))))[0])
    return F.reduce(candidates, F.lit(None).cast(kind), step)


def _replace(df: DataFrame, drop: str, out: str, value: Column) -> DataFrame:
    if out in df.columns:
        raise ValueError(f"the rows have a column {out} already")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != drop], value.alias(out))


def extract_field(df: DataFrame, text_col: str, query_col: str, patterns: DataFrame, out: str = "value",
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` with the value of the first pattern, by priority, that has a keyword in
    the query and matches the text (null: none)."""
    rows, c = _with_candidates(df, F.lower(F.col(query_col)), text_col, patterns, _Keywords, None, part_bytes, True)
    return _replace(rows, c, out, _first(F.col(text_col), F.col(c))["value"])


def extract_fields(df: DataFrame, text_col: str, query_col: str, patterns: DataFrame, out: str = "fields",
                   part_bytes: int = PART_BYTES) -> DataFrame:
    """F14 of the patterns that have a keyword in the query: ``df`` with a map of field to
    value. Of several patterns of one field that match, the one with the highest ord counts."""
    rows, c = _with_candidates(df, F.lower(F.col(query_col)), text_col, patterns, _Keywords, None, part_bytes)
    text = F.col(text_col)
    found = F.filter(F.transform(c, lambda x: F.struct(x["field"].alias("field"), x["ord"].alias("ord"), _value(text, x).alias("value"))),
                     lambda x: x["value"].isNotNull() & x["field"].isNotNull())
    # a field's patterns stand together by rising ord: its last is kept (the array is bound once)
    last = F.transform(F.array(F.array_sort(found)), lambda s: F.filter(
        s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["field"] != x["field"])))[0]
    return _replace(rows, c, out, F.map_from_entries(F.transform(last, lambda x: F.struct(x["field"], x["value"]))))


def fuzzy_extract_field(df: DataFrame, text_col: str, query_col: str, patterns: DataFrame, threshold: float = FUZZY_THRESHOLD,
                        out: str = "fuzzy", part_bytes: int = PART_BYTES) -> DataFrame:
    """``df`` with struct(value, confidence) of the pattern that matches the text and whose
    keywords are most similar to the query's words (Jaccard, ``threshold`` or more; the lowest
    ord on ties). A blank best value gives null."""
    if not threshold > 0:
        raise ValueError("the threshold must be over 0: any pattern has a similarity of 0")
    words = F.array_distinct(whitespace_words(F.lower(F.col(query_col))))
    rows, c = _with_candidates(df, words, text_col, patterns, _Similar, float(threshold), part_bytes)
    order = F.array_sort(c, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1)
                         .when(a["ord"] < b["ord"], -1).otherwise(1))
    best = F.transform(F.array(_first(F.col(text_col), order)), lambda x: F.when(x.isNotNull() & (x["value"] != ""), x))[0]
    return _replace(rows, c, out, best)
