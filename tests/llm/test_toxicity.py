import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import make_docs, odd_rows, prose  # noqa: F401

from shelfwise.llm import gru, toxicity
from shelfwise.llm.words import Words

BAD = ["blarghead", "snotwit", "grumblefool", "dungbrain"]


def labelled(n, start=0):
    """(rows, labels): a third of the texts hold bad words, a few in many others; some
    as compounds never seen in training."""
    r, rows, labels = random.Random(start), [], []
    for i in range(start, start + n):
        words = prose(r.choice([8, 40, 150, 400]), i).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(1 + len(words) // 40):
                w = r.choice(BAD)
                words[r.randrange(len(words))] = w.upper() if r.random() < 0.2 else w + r.choice(["", "", "s", "!"])
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def world(spark):
    rows, labels = labelled(900)
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict((a, c) for a, _, c in labels)


def test_held_out_rows_are_told_apart(world, make_docs):
    rows, labels, truth = world
    got = toxicity.toxicity_scores(make_docs(rows, clashing=True), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    test = [(r.score, truth[r.doc_id]) for r in got if r.held_out]
    pairs = [(a > b) + (a == b) / 2 for a, y in test for b, z in test if y and not z]
    assert np.mean(pairs) > 0.95
    assert np.mean([(s >= 0.7) == y for s, y in test]) > 0.93


def test_labels_of_held_out_rows_do_not_matter(world, make_docs, spark):
    rows, labels, _ = world
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    docs = make_docs(rows)
    assert toxicity.train(docs, labels, 60, 60) == toxicity.train(docs, flipped, 60, 60)


def test_odd_rows_keep_their_columns(world, make_docs, spark):
    rows, labels, _ = world
    model = toxicity.train(make_docs(rows), labels, 100, 100)
    docs = make_docs(odd_rows(), clashing=True)
    out = toxicity.score(docs, model)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(odd_rows())
    empty = {r.score for r in out.collect() if r.text in (None, "")}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    kept = toxicity.drop_toxic(docs, labels, make_docs(rows))
    assert kept.columns == docs.columns


def test_without_labels_of_both_kinds_scores_are_zero(world, make_docs, spark):
    rows, labels, _ = world
    docs = make_docs(rows[:20])
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.selectExpr("doc_id", "quality", "cast(null as int) as toxic")):
        assert {r.score for r in toxicity.toxicity_scores(docs, some).collect()} == {0.0}
    assert toxicity.toxicity_scores(make_docs([]), labels).collect() == []


def test_windows_cover_every_word_and_overlap():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 1000])
    text, first = gru.windows(counts)
    for i, n in enumerate(counts):
        starts = first[text == i]
        assert starts[0] == 0 and (np.diff(starts) == gru.STRIDE).all()
        assert starts[-1] + gru.WINDOW >= n and (len(starts) == 1 or starts[-2] + gru.WINDOW < n)


def test_gradients_equal_differences():
    words = Words(pa.array([prose(40, 1), prose(20, 2)]))
    codes, hashes, slots, sizes = gru.distinct_words(words)
    net = gru.Network(np.sort(hashes[::2]), 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = net.rows(hashes)
    text, first = gru.windows(words.counts())
    local = gru.window_codes(codes, words.offsets, text, first, len(hashes))
    x = net.inputs(rows, slots, sizes).astype(np.float64)
    way = np.random.default_rng(0).normal(size=len(text))
    _, saved = net.forward(x, local, keep=True)
    grads, dx = net.backward(x, local, way, saved)
    for name, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, ends = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = kept + step
            ends.append(float(net.forward(x, local) @ way))
        net.p[name][at] = kept
        assert np.isclose((ends[0] - ends[1]) / 2e-2, grad[at], rtol=0.05, atol=1e-3), name
    at = np.unravel_index(np.abs(dx).argmax(), dx.shape)
    ends = []
    for step in (1e-2, -1e-2):
        y = x.copy()
        y[at] += step
        ends.append(float(net.forward(y, local) @ way))
    assert np.isclose((ends[0] - ends[1]) / 2e-2, dx[at], rtol=0.05, atol=1e-3)


def test_a_text_is_scored_alike_alone_and_among_others():
    texts = [prose(n, n) for n in (1, 31, 32, 100, 700)] + ["", "blarghead"]
    net = gru.Network(np.zeros(0, np.uint64))
    together = net.text_logits(Words(pa.array(texts)))
    for t, want in zip(texts, together, strict=True):
        assert np.isclose(net.text_logits(Words(pa.array([t])))[0], want, atol=1e-5)
    again = gru.Network.from_bytes(net.to_bytes())
    assert np.array_equal(again.text_logits(Words(pa.array(texts))), together)


def test_texts_without_words_score_alike_whatever_is_beside_them():
    texts = ["one two three", None, "", " \n\t.,!", prose(100, 99), "short text", None]
    one, many = Words(pa.array([""], pa.large_string())), Words(pa.array(texts, pa.large_string()))
    for seed in range(4):
        net, r = gru.Network(np.zeros(0, np.uint64), seed), np.random.default_rng(seed)
        for k in ("b", "ba", "bo", "wo", "va"):
            net.p[k] = r.normal(0, 1, net.p[k].shape).astype(np.float32)
        net.p["bo"] -= net.text_logits(one)  # near 0 the last bits show
        got = net.text_logits(many).tolist()
        assert {got[i] for i in (1, 2, 3, 6)} == {float(net.text_logits(one)[0])}
