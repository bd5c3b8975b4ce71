import pytest

import __spark_entry__ as E

from conftest import SF001


def test_lsh_settings_for_recall_reach_it(spark):
    row = E.queries()["lsh_recall_r90"](spark, SF001).first()
    assert (row.config_name, row.k) == ("hnsw_l2", 5) and row.overlap >= 0.9


def test_probe_count_for_recall_reaches_it_and_equals_the_searches(spark):
    q = E.queries()
    got = {r.nprobe: r.recall for r in q["ivf_recall_by_probe"](spark, SF001).collect()}
    true = {(r.query_id, r.vec_id) for r in q["knn_l2"](spark, SF001).collect()}
    for nprobe, name in ((2, "ivf_probe2"), (8, "ivf_probe8")):
        found = {(r.query_id, r.vec_id) for r in q[name](spark, SF001).collect()}
        assert got[nprobe] == pytest.approx(len(true & found) / len(true), abs=1e-6)
    assert got[8] >= 0.9 and got[10] == 1.0
