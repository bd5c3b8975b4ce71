import datetime as dt

import numpy as np
import pytest

from shelfwise.operators import metrics, sketches

PROBS = [0.1, 0.5, 0.95, 0.99]


def frame(spark, values, day):
    return spark.createDataFrame([(g, dt.date(2025, 1, day), v) for g, v in values], "g string, d date, v double")


def test_days_are_added_without_reading_others_and_errors_are_bounded(spark, tmp_path):
    rng = np.random.default_rng(1)
    path = str(tmp_path / "days")
    days = {d: [("a", float(x)) for x in rng.lognormal(3, 1, 4000 * d)] + [("b", float(d))] * 50 + [("c", None)] for d in (1, 2, 3)}
    for d in (1, 2, 3):
        sketches.add_days(frame(spark, days[d], d), path, "v", ["g"], "d")
    sketches.add_days(frame(spark, days[2], 2), path, "v", ["g"], "d")   # a replayed day replaces itself
    got = {r["g"]: r for r in sketches.merged(sketches.read_days(spark, path), ["g"], PROBS).collect()}
    a = np.sort([v for d in days.values() for g, v in d if g == "a"])
    assert got["a"]["n"] == len(a) == 24000
    assert got["a"]["mean"] == pytest.approx(a.mean()) and got["a"]["std"] == pytest.approx(a.std())
    assert (got["a"]["low"], got["a"]["high"]) == (a[0], a[-1])
    for p, q in zip(PROBS, got["a"]["quantiles"], strict=True):
        assert abs(np.searchsorted(a, q, "right") / len(a) - p) <= sketches.RANK_ERROR
    assert got["b"]["n"] == 150 and got["b"]["quantiles"][1] == 2.0
    assert got["c"]["n"] == 0 and got["c"]["quantiles"] is None and got["c"]["mean"] is None
    total = sketches.merged(sketches.read_days(spark, path).where("day >= '2025-01-02'"), [], PROBS).first()
    assert total["n"] == 20000 + 100


def test_first_n_and_latency_rows(spark):
    df = spark.createDataFrame([(i, float(10 * i), 1 + i % 2) for i in range(6, 0, -1)], "id bigint, v double, k int")
    assert [r["id"] for r in metrics.first_n(df, "id", 3).collect()] == [1, 2, 3]
    got = {(r["section"], r["metric"]): r["value"] for r in metrics.latency_rows(df, "v", "k", ["mean_latency_ms", "median_latency_ms"]).collect()}
    assert got == {("latency", "mean_latency_ms@1"): 40.0, ("latency", "median_latency_ms@1"): 40.0,
                   ("latency", "mean_latency_ms@2"): 30.0, ("latency", "median_latency_ms@2"): 30.0}
