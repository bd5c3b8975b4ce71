import math
import random

import numpy as np
import pytest

from shelfwise.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score bigint, dim string, block string, codes string"


def rows(n, dim, seed=1, small=False):
    r = np.random.default_rng(seed)
    data = r.normal(0, 0.02 if small else 0.3, (n, dim)).astype(np.float32)
    return [(i, [float(x) for x in v], 0, 1, "d", "b", "c") for i, v in enumerate(data)]


def brute(all_rows, every, k):
    good = {}
    for i, v, *_ in all_rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(v)] = np.array([math.floor(64 * float(np.float32(x))) for x in v], np.int64)
    out = set()
    for (i, _), q in good.items():
        if i % every == 0:
            scored = sorted((-int(q @ c), j) for (j, _), c in good.items() if j != i and len(c) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def found(df):
    return {tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect()}


@pytest.mark.parametrize("dim,small", [(64, False), (3, False), (16, True)])
def test_equal_to_brute_force_over_several_blocks(spark, monkeypatch, dim, small):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    data = rows(700, dim, dim, small)
    r = random.Random(1)
    data += [(1000 + i, data[7][1], 0, 1, "d", "b", "c") for i in range(300)]  # one vector very often: ties
    data += [(2000 + i, [0.0] * dim, 0, 1, "d", "b", "c") for i in range(25)] + data[:30]
    data += [(3000, None, 0, 1, "", "", ""), (3020, [], 0, 1, "", "", ""), (3040, [float("nan")] * dim, 0, 1, "", "", ""),
             (3060, [None] * dim, 0, 1, "", "", ""), (3080, [float("inf")] * dim, 0, 1, "", "", ""),
             (None, data[3][1], 0, 1, "", "", ""), (3100, [0.5] * (dim + 1), 0, 1, "", "", ""), (3101, [0.25] * (dim + 1), 0, 1, "", "", "")]
    r.shuffle(data)
    ints = topk.integers(spark.createDataFrame(data, SCHEMA))
    got = topk.search(ints.filter("vec_id % 20 = 0"), topk.build_index(ints, block=128), 20)
    assert found(got) == brute(data, 20, 20)


def test_processing_stops_early_on_proof():
    r = np.random.default_rng(3)
    codes = r.integers(-3, 4, (5000, 8))
    codes[42] = 60  # far ahead of all others
    b = topk.Block.build(np.arange(5000), codes)
    _, ids, scores = b.top(np.array([-1]), np.full((1, 8), 9), 1)
    assert ids.tolist() == [42] and scores.tolist() == [8 * 60 * 9]
    assert b.passes == topk.FIRST_LOOK + 1 < 2 * topk.LEVELS - 1 and b.survivors < 50


def test_few_vectors_are_scored_exactly():
    r = np.random.default_rng(8)
    codes = np.floor(64 * r.normal(0, 0.125, (4096, 64))).astype(np.int64)
    b = topk.Block.build(np.arange(4096), codes)
    queries = codes[:100]
    row, ids, scores = b.top(np.arange(100), queries, 20)
    assert b.survivors < 100 * 4096 / 8
    s = queries @ codes.T
    s[np.arange(100), np.arange(100)] = -10 ** 9
    for i in range(100):
        want = sorted(zip(-s[i], range(4096), strict=True))[:20]
        assert [(-x, j) for x, j in zip(scores[row == i], ids[row == i], strict=True)] == want


def test_a_known_floor_only_leaves_out_what_is_below_it():
    r = np.random.default_rng(5)
    codes = r.integers(-20, 21, (3000, 16))
    b = topk.Block.build(np.arange(3000) // 2, codes)  # ids occur twice
    own = np.array([0, 7, 1499, 5000])
    queries = r.integers(-20, 21, (4, 16))
    for known in (None, 19, 9):
        wants = []
        for i, q in zip(own, queries, strict=True):
            scores = codes @ q
            wants.append(sorted((-int(x), j // 2) for j, x in enumerate(scores) if j // 2 != i)[:20])
        floor = None if known is None else np.array([-w[known][0] for w in wants])
        row, ids, got = b.top(own, queries, 20, floor)
        for i, want in enumerate(wants):
            kept = [(x, j) for x, j in want if floor is None or -x >= floor[i]]
            assert [(-int(x), int(j)) for j, x in zip(ids[row == i], got[row == i], strict=True)][:len(kept)] == kept


def test_fewer_candidates_than_k_and_none(spark):
    data = rows(5, 4)
    assert found(topk.top_k(spark.createDataFrame(data, SCHEMA))) == brute(data, 20, 20)
    assert found(topk.top_k(spark.createDataFrame([], SCHEMA))) == set()
    assert found(topk.top_k(spark.createDataFrame(rows(1, 4), SCHEMA))) == set()


@pytest.mark.parametrize("size", [3e3, 2e5, 1e9, 1e15])
def test_large_finite_components_are_scored_exactly(spark, size):
    r = np.random.default_rng(2)
    data = rows(80, 6)
    for i in range(0, 80, 7):  # some rows are large, and their products beyond float64's integers, or a long
        data[i] = (i, [float(np.float32(x)) for x in r.normal(0, size, 6)], *data[i][2:])
    want = {(q, n, v, max(min(s, 2 ** 63 - 1), -2 ** 63)) for q, n, v, s in brute_wide(data, 20, 20)}
    assert found(topk.top_k(spark.createDataFrame(data, SCHEMA))) == want


def brute_wide(all_rows, every, k):
    codes = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v, *_ in all_rows}
    out = set()
    for i, q in codes.items():
        if i % every == 0:
            # scores cut to a long tie there and go by id
            cut = lambda s: max(min(s, 2 ** 63 - 1), -2 ** 63)
            scored = sorted((-cut(sum(x * y for x, y in zip(q, c, strict=True))), j) for j, c in codes.items() if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def test_huge_components_do_not_fail(spark):
    got = found(topk.top_k(spark.createDataFrame([(0, [3e38], 0, 1, "", "", ""), (1, [1.0], 0, 1, "", "", ""), (2, [-3e38], 0, 1, "", "", "")], SCHEMA)))
    assert got == {(0, 1, 1, 2 ** 63 - 1), (0, 2, 2, -2 ** 63)}
