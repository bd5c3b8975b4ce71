r"""License scans by an exact set-similarity join (native: DataFrame functions only).

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased. A text
is cut into blocks: for templates of at most w words, windows of 2w words every w words
(w = 16, 32, 64, ...; see :func:`width`), so any run of w words lies whole in a block.
A block matches a template if at least THRESHOLD percent of the template's distinct
words are among the block's. Every such (block, template) pair is found:

* words are ordered by how many documents hold them, rarest first, over the whole
  corpus (only the templates' words matter: no other can be shared);
* prefix filter: with m words, of which o = ceil(threshold m) must be shared, a template
  meets a block of n template words by equality on one of its first m - o + 1 words and
  one of the block's first n - o + 1;
* length filter: n >= o; positional filter: at the first shared word, at places i and j
  (from 0), at most min(m - i, n - j) words can be shared, which must be o or more; a pair
  is kept only there, so it appears once;
* what is left is verified on the full sets.

Beside it the base phrases are counted at every place where their words stand together.

The texts are read and cut into words once: blocks are written with their words in any
order, next to the template words of each document, whose counts then give the order.

One row is one document; blocks that can match are the only rows that are exploded, and
nothing but their labels is shuffled with the document's figures. Templates are a
parameter (some thousand texts at most): their words and prefixes go to the tasks as
literals and as a broadcast table of at most their number of words.

Defined cases: null text counts as empty (no words, no labels, score 0); repeated rows
give repeated results; a null doc_id is kept; a text of any length is as many blocks as
it needs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Notices of well-known public licences, by SPDX-like label.
TEMPLATES = (
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
                   "or implied. See the License for the specific language governing permissions and limitations "
                   "under the License."),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
                         "the GNU General Public License as published by the Free Software Foundation, either "
                         "version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:"),
)
THRESHOLD = 90   # percent of a template's distinct words
LEAST_WIDTH = 16

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; a text of ASCII alone by the engine's own, faster function."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def width(n_words: int) -> int:
    """Half the length of the blocks for a template of ``n_words`` words."""
    w = LEAST_WIDTH
    while w < n_words:
        w *= 2
    return w


def _needed(m: int, threshold: int) -> int:
    return -(-m * threshold // 100)


def _places(words: Column, phrase: str) -> Column:
    """Word numbers (from 0) at which the phrase stands."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    here = lambda i: F.forall(
        F.array(*[F.get(words, i + j) == F.lit(p) for j, p in enumerate(parts)]), lambda x: x)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def base_matches(text: Column, words: Column) -> Column:
    """array<struct<at, label>> of the base phrases' places. Only texts in which a phrase's
    first two words meet are looked at word by word."""
    heads = "|".join(f"{p.split()[0]}{_SEPARATOR}+{p.split()[1]}" for p, _ in PHRASES)
    marked = lambda label: lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label"))
    found = F.concat(*[F.transform(_places(words, p), marked(label)) for p, label in PHRASES])
    return F.when(text.rlike(f"(?:{heads})"), found).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))


def word_frequencies(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each template word (``held``, distinct per document): at
    most ``len(vocabulary)`` rows."""
    counts = {r["word"]: r["n"] for r in rows.select(F.explode("held").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _blocks(words: Column, w: int, vocabulary: list[str], least: int) -> Column:
    """The blocks of 2w words that hold ``least`` words of the vocabulary or more, as
    array<struct<width, block, words>>; a text that holds fewer is not cut."""
    last = F.greatest(F.ceil(F.size(words) / w).cast("int") - 2, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.lit(w).alias("width"), i.alias("block"),
        F.array_intersect(F.lit(vocabulary), F.slice(words, i * w + 1, F.lit(2 * w))).alias("words")))
    held = F.array_intersect(F.lit(vocabulary), words)
    return F.when(F.size(held) >= least, F.filter(cut, lambda b: F.size(b["words"]) >= least)).otherwise(
        F.array().cast("array<struct<width:int,block:int,words:array<string>>>"))


def _with_words(docs: DataFrame) -> DataFrame:
    low = docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("low"))
    # what stands between separators, without the empty string before a first and after a last one
    return low.withColumn("words", F.array_remove(F.split("low", f"{_SEPARATOR}+"), ""))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(one row a document: key, doc_id, n_words, base; one row per matching (key, width,
    block, template): label, shared, m). ``key`` is null where no block can match."""
    spark = docs.sparkSession
    sets = [(label, words, width(len(words))) for label, words in ((x, template_words(t)) for x, t in templates) if words]
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    least = {}
    for _, words, w in sets:
        needed = _needed(len(set(words)), threshold)
        least[w] = min(least.get(w, needed), needed)
    blocks = [_blocks(F.col("words"), w, sorted({x for _, words, v in sets if v == w for x in words}), least[w]) for w in sorted(least)]

    rows = _with_words(docs).select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), base_matches(F.col("low"), F.col("words")).alias("base"),
        F.concat(*blocks).alias("blocks"), F.array_intersect(F.lit(vocabulary), F.col("words")).alias("held"),
        F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("low")), 256).alias("key"))
    rows = written(rows.withColumn("key", F.when(F.size("blocks") > 0, F.col("key"))), "license-blocks")

    frequency = word_frequencies(rows, vocabulary)
    order = lambda words: sorted(set(words), key=lambda w: (frequency[w], w))
    prefixes = []
    for number, (label, words, w) in enumerate(sets):
        rare = order(words)
        m, needed = len(rare), _needed(len(rare), threshold)
        prefixes += [(w, word, number, label, i, m, needed, rare) for i, word in enumerate(rare[:m - needed + 1])]

    least_of = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    parts = (rows.filter("key IS NOT NULL").select("key", F.explode("blocks").alias("b"))
             .select("key", "b.width", "b.block", F.array_intersect(F.lit(order(vocabulary)), F.col("b.words")).alias("held")).distinct()
             .withColumn("n", F.size("held"))
             .select("*", F.posexplode(F.slice("held", F.lit(1), F.col("n") - least_of[F.col("width")] + 1)).alias("j", "word")))
    prefix = spark.createDataFrame(
        prefixes, "width int, word string, template int, label string, i int, m int, needed int, template_words array<string>")
    met = (parts.join(F.broadcast(prefix), ["width", "word"])
           .filter((F.col("n") >= F.col("needed")) & (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= F.col("needed")))
           .filter(~F.arrays_overlap(F.slice("template_words", F.lit(1), F.col("i")), F.slice("held", F.lit(1), F.col("j"))))
           .withColumn("shared", F.size(F.array_intersect("template_words", "held")))
           .filter(F.col("shared") >= F.col("needed"))
           .select("key", "width", "block", "template", "label", "shared", "m"))
    return rows.drop("blocks", "held"), met


def license_digest(docs: DataFrame, templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """The contract's columns per document, and ``n_blocks``: how many (block, template)
    pairs match. The score is 1 where a base phrase stands, else the highest share of a
    template's words held by a block that matches it, else 0."""
    rows, met = scan(docs, templates, threshold)
    found = met.groupBy("key").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("m")).alias("share"),
                                   F.count(F.lit(1)).alias("n_blocks"))
    places, marks = F.col("base.at"), F.array_distinct("base.label")
    # documents without a block that can match need not move
    joined = rows.filter("key IS NOT NULL").join(found, "key", "left").unionByName(
        rows.filter("key IS NULL"), allowMissingColumns=True)
    return joined.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(marks), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(marks, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0).cast("bigint")).alias("n_blocks"))


def license_sql(templates=TEMPLATES, threshold: int = THRESHOLD) -> str:
    """DuckDB SQL for :func:`license_digest`: every block against every template, no filters."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(label)}, {width(len(template_words(t)))}, {quote(t)})"
                     for i, (label, t) in enumerate(templates))
    phrases = ", ".join(f"({quote(p)}, {quote(label)}, {len(p.split())})" for p, label in PHRASES)
    low = lambda c: f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({low('text')}, '{WORD}') AS w FROM documents),
t AS (SELECT i, label, half, list_distinct(regexp_extract_all({low('t')}, '{WORD}')) AS words
      FROM (VALUES {rows}) v(i, label, half, t)),
b AS (SELECT r, half, list_distinct(w[a * half + 1:(a + 2) * half]) AS words
      FROM d, (SELECT DISTINCT half FROM t) h, unnest(range(0, greatest(CAST(ceil(len(w) / half) AS BIGINT) - 2, 0) + 1)) u(a)),
m AS (SELECT r, label, len(list_intersect(t.words, b.words)) AS shared, len(t.words) AS m FROM b JOIN t ON b.half = t.half),
x AS (SELECT r, list_distinct(list(label)) AS found, max(shared / m) AS share, count(*) AS n FROM m
      WHERE shared * 100 >= m * {threshold} GROUP BY r),
p AS (SELECT r, g - 1 AS at_, label FROM d, unnest(range(1, len(w) + 1)) u(g), (VALUES {phrases}) q(phrase, label, size)
      WHERE array_to_string(w[g:g + size - 1], ' ') = phrase),
y AS (SELECT r, count(*) AS n, min(at_) AS a, max(at_) AS z, list_distinct(list(label)) AS base FROM p GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(y.n, 0) AS n_base, y.a AS first_word, y.z AS last_word,
       coalesce(array_to_string(list_sort(y.base), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(y.base, []), coalesce(x.found, [])))), ',') AS labels,
       CASE WHEN y.n > 0 THEN 1.0::DOUBLE ELSE coalesce(x.share, 0.0)::DOUBLE END AS score, coalesce(x.n, 0) AS n_blocks
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""
