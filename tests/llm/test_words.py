import re

import numpy as np
import pyarrow as pa

from shelfwise.llm.words import Words, grams, word_slices


def plain(text):
    return re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", (text or "").lower())


TEXTS = ["Hello, World!", None, "", "a b", "été ÉTÉ", "..", "x", "tail head", "a_b-c d1", "é" * 5000 + " z", "no.gap", "end"]


def test_words_equal_a_regular_expression_over_any_slicing():
    for size in (1, 10, 10**6):
        got, ids = [], {}
        for a, b, w in word_slices(pa.array(TEXTS), size):
            assert len(w) == b - a
            for i in range(b - a):
                got.append(w.hashes[w.offsets[i]:w.offsets[i + 1]].tolist())
        for text, hashes in zip(TEXTS, got, strict=True):
            assert len(plain(text)) == len(hashes)
            for word, h in zip(plain(text), hashes, strict=True):
                assert ids.setdefault(word, h) == h
        assert len(set(ids.values())) == len(ids)


def test_grams_stay_inside_texts_and_short_texts_have_one():
    w = Words(pa.array(["a b c d e f", "a b", "", "a b c d e", "c d e f g"]))
    hashes, text = grams(w, 5)
    assert text.tolist() == [0, 0, 1, 3, 4]
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 4


def test_joined_parts_are_like_one_table():
    whole = Words(pa.array(TEXTS))
    parts = Words.concat([w for _, _, w in word_slices(pa.array(TEXTS), 1)])
    for name in ("bytes", "starts", "ends", "offsets", "hashes"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name
