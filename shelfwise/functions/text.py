"""Text column functions (X1, X2, X11, whitespace words, strip)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode word class: letters, numbers, underscore (Java's \w is ASCII only).
WORD_PATTERN = r"([\p{L}\p{N}_]+)"


# White space as Python's str has it, in terms that Java and RE2 both know.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Strip leading/trailing white space, Unicode's too (``trim`` removes spaces only)."""
    return F.regexp_replace(_c(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def tokens(c) -> Column:
    """Lower-cased word tokens with repeats, in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(WORD_PATTERN), 1)


def token_set(c) -> Column:
    """Distinct lower-cased word tokens (a set, kept in first-seen order)."""
    return F.array_distinct(tokens(c))


def overlap(a, b) -> Column:
    """Number of shared distinct tokens of two token sets."""
    return F.size(F.array_intersect(_c(a), _c(b)))


def whitespace_words(c) -> Column:
    """Words split on runs of whitespace, empties dropped (``str.split()``)."""
    return F.filter(F.split(strip(F.coalesce(_c(c), F.lit(""))), rf"{SPACE}+"), lambda x: x != "")


def word_count(c) -> Column:
    return F.size(whitespace_words(c))


def cut_at_first_stop(text, stops: list[str]) -> Column:
    """X11: cut at the first listed stop string present, then strip.

    Only the first stop (in list order) that occurs applies, as in the
    reference; later stops are not looked for after a cut.
    """
    t = strip(_c(text))
    out = t
    for stop in reversed(stops):
        out = F.when(F.instr(t, stop) > 0,
                     strip(F.substring_index(t, stop, 1))).otherwise(out)
    return out
