import random
import re

import pytest
from llm_rows import make_docs, odd_rows, prose  # noqa: F401

from shelfwise.llm import jaccard
from shelfwise.llm.components import components


def gram_set(text):
    w = re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(class_id, n_links) per row number."""
    sets = [gram_set(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return [(r[0], names.get(find(i)), links[i]) for i, r in enumerate(rows)]


def near_rows():
    """Groups of near copies of several sizes, each edited on its own."""
    r, rows = random.Random(5), []
    for group, size in enumerate((2, 3, 40, 90)):
        base = prose(120, group).split()
        for _ in range(size):
            words = list(base)
            for k in r.sample(range(len(words)), r.randint(0, 4)):
                words[k] = f"edit{r.randint(0, 9)}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    return rows + [(1000 + i, prose(80, 500 + i), "en", "s", 1) for i in range(30)]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("block", [8, 256])
def test_classes_and_links_equal_brute_force(make_docs, block):
    rows = near_rows()
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(make_docs(rows), block=block).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_odd_rows_and_clashing_columns(make_docs):
    rows = odd_rows() + [(7, "ONE two, three four five six seven!", "en", "s", 1)]
    out = jaccard.jaccard_classes(make_docs(rows, clashing=True)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=key) == sorted(brute(rows), key=key)
    alone = [r.class_key for r in out if r.doc_id in (2, 3, 4)]
    assert len(set(alone)) == 3


def test_one_document_of_each_class_stays_with_all_columns(make_docs):
    rows = near_rows() + [(1000, prose(80, 500), "en", "s", 1)]
    docs = make_docs(rows, clashing=True)
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {c for _, c, _ in brute(rows)}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want)


def test_empty_texts_are_kept(make_docs):
    kept = jaccard.drop_near_copies(make_docs(odd_rows())).collect()
    assert {2, 3, 4, 5, 6} <= {r.doc_id for r in kept}
    assert sum(r.doc_id == 1 for r in kept) == 1


def test_empty_table(make_docs):
    assert jaccard.jaccard_classes(make_docs([])).collect() == []


def test_band_choice_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = jaccard.bands_and_rows(threshold, 0.999, 512)
        assert 1 - (1 - threshold ** rows) ** bands >= 0.999
    assert jaccard.bands_and_rows(0.8, 0.9999) == (18, 4)
    with pytest.raises(ValueError):
        jaccard.bands_and_rows(0.1, 0.9999, 8)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(500, 600 + i) for i in range(40)]
    edges = [tuple(f"{x:04d}".encode() for x in e) for e in chain + star + [(900, 900)]]
    random.Random(1).shuffle(edges)
    got = {bytes(r.node): bytes(r.component) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {f"{x:04d}".encode(): b"0000" for x in range(61)} | {
        f"{x:04d}".encode(): b"0500" for x in [500, *range(600, 640)]}
