import itertools
import random
import re

import numpy as np
from llm_rows import make_docs, odd_rows, prose  # noqa: F401

from shelfwise.llm import decontam as D


def test_masks_lose_no_window_with_so_many_substitutions():
    places = [tuple(o + i for i, c in enumerate(m) if c == "1") for m in D.MASKS for o in range(D.WINDOW - len(m) + 1)]
    for bad in itertools.combinations(range(D.WINDOW), D.MISMATCHES):
        assert any(not set(p) & set(bad) for p in places), bad


def test_masks_of_short_items_lose_none_of_their_substitutions():
    for n in range(D.SHORTEST, D.WINDOW):
        width, allowed = D.tolerance(n)
        assert width == n
        places = [tuple(o + i for i, c in enumerate(m) if c == "1") for m in D.item_masks(n) for o in range(n - len(m) + 1)]
        for bad in itertools.combinations(range(n), allowed):
            assert any(not set(p) & set(bad) for p in places), (n, bad)
    assert [D.tolerance(n)[1] for n in range(5, 14)] == [0, 0, 0, 1, 1, 2, 2, 2, 3]


def plain_overlaps(rows, bench):
    """(doc_id, item_id) of all documents and items of which some aligned stretch of the
    item's words (13 of a long item) differs in no more places than allowed."""
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    out = set()
    for doc_id, text, *_ in rows:
        doc = words(text)
        for item_id, item_text in bench:
            item = words(item_text)
            n = len(item)
            allowed = 3 if n >= 13 else 2 if n >= 10 else 1 if n >= 8 else 0
            width = min(n, 13)
            if n >= 5 and any(sum(a != b for a, b in zip(doc[i:i + width], item[j:j + width], strict=True)) <= allowed
                              for j in range(n - width + 1) for i in range(len(doc) - width + 1)):
                out.add((doc_id, item_id))
    return out


def test_whole_query_against_brute_force(spark, make_docs):
    r = random.Random(9)
    bench = [(n, prose(n, 500 + n)) for n in range(3, 24)]
    rows = []
    for k in range(160):
        n, text = bench[k % len(bench)]
        item = text.split()
        cut = item[r.randint(0, max(0, n - 14)):] if k % 3 == 0 else item
        for p in r.sample(range(len(cut)), min(len(cut), r.randint(0, 5))):
            cut[p] = f"other{r.randint(0, 9)}"
        rows.append((k, f"{prose(20, k)} {' '.join(cut)} {prose(20, 900 + k)}", "en", "s", 1))
    want = plain_overlaps(rows, bench)
    lengths = {i for _, i in want}
    assert lengths >= {6, 8, 9, 10, 11, 12, 13, 20} and len(want) < len(rows)
    assert set(found(make_docs(rows), items(spark, bench))) == want


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def found(docs, bench):
    return {(r.doc_id, r.item_id): (r.first_word, r.end_word, r.equal_words) for r in D.overlaps(docs, bench).collect()}


def test_passages_with_substitutions_are_found_and_others_not(spark, make_docs):
    r = random.Random(2)
    bench = [(i, prose(30, 1000 + i)) for i in range(12)] + [(50, prose(8, 77)), (51, "too short to find"), (52, None), (None, prose(20, 88))]
    rows, want = [], set()
    for k in range(60):
        item = bench[k % 12]
        words = item[1].split()
        for p in range(k % 7, 30, 5 if k < 40 else 2):  # every fifth word differs, or every second
            words[p] = f"sub{r.randint(0, 99)}"
        rows.append((1000 + k, f"{prose(60, k)} {' '.join(words)}. {prose(40, 300 + k)}", "en", "s", 1))
        if k < 40:
            want.add((1000 + k, item[0]))
    rows += [(100, f"{prose(50, 7)} {bench[12][1].upper()}!", "en", "s", 1), (101, bench[15][1], "en", "s", 1),
             (102, "too short to find", "en", "s", 1), (103, prose(400, 9), "en", "s", 1)] + odd_rows()
    want |= {(100, 50), (101, None)}
    got = found(make_docs(rows, clashing=True), items(spark, bench))
    assert set(got) == want
    assert got[100, 50] == (50, 58, 8) and got[101, None] == (0, 20, 20)
    kept = {r.doc_id for r in D.drop_contaminated(make_docs(rows, clashing=True), items(spark, bench)).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}


def test_equal_items_and_repeated_rows(spark, make_docs):
    text = prose(25, 3)
    got = found(make_docs([(1, text, "en", "s", 1)] * 3), items(spark, [(1, text), (2, text), (2, text)]))
    assert got == {(1, 1): (0, 25, 25), (1, 2): (0, 25, 25)}


def test_null_doc_id_does_not_hide(spark, make_docs):
    text = prose(25, 3)
    kept = D.drop_contaminated(make_docs([(None, text, "en", "s", 1), (None, "clean", "en", "s", 1)]), items(spark, [(1, text)]))
    assert [r.text for r in kept.collect()] == ["clean"]


def test_empty_tables(spark, make_docs):
    assert found(make_docs([]), items(spark, [(1, prose(20, 1))])) == {}
    assert found(make_docs(odd_rows()), items(spark, [])) == {}


def test_longest_overlap_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(300):
        item = r.integers(0, 1000, r.integers(13, 40))
        doc = np.concatenate([r.integers(1000, 2000, 10), item, r.integers(1000, 2000, 10)])
        doc[r.random(len(doc)) < 0.2] = -1
        good = [i for i in range(len(item) - 12) if (doc[10 + i:23 + i] == item[i:i + 13]).sum() >= 10]
        got = D.longest_overlap(doc, item, 10)
        assert (got is None) == (not good)
        if got:
            assert got[2] == (doc[got[0]:got[1]] == item[got[0] - 10:got[1] - 10]).sum() >= 10
