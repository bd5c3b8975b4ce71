import duckdb
import pytest

import __spark_entry__ as E
from shelfwise.sources.tables import TABLES

from conftest import SF0001


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "rank", "vec_id", "label", "dist"]


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


FAST = ["knn_l2", "knn_batch_k", "metadata_accept", "ground_truth_pairs", "extract_by_query", "fuse_attention",
        "context", "catalogue_search", "bleu", "latency_stats", "recall_at_k", "contrastive"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle_at_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = E.queries()[name](spark, SF0001)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)

    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, list):
            return tuple(norm(x) for x in v)
        return v
    order = sorted(cols)
    s = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    idx = [cols.index(c) for c in order]
    d = sorted(tuple(norm(r[i]) for i in idx) for r in res.fetchall())
    assert s == d
