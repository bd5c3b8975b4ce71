import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_url_filters", "op3_jaccard_join", "op7_warc", "op9_topk", "op10_chat_formatting",
                                  "op11_license_scans", "op13_fill_in_middle"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in sorted(df.columns)]
    want = sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == want
