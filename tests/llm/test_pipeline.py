import corpus_pipeline
from llm_rows import CLASHING, DOCS, make_docs, odd_rows, prose  # noqa: F401

import __spark_entry__ as E


def test_stages_keep_clean_documents_and_columns(spark, make_docs, tmp_path):
    clean = [(1000 + i, prose(60, 2000 + i), "en", "s", 5) for i in range(40)]
    passage = prose(30, 1)
    rows = clean + odd_rows() + [(2000, clean[0][1] + " more", "en", "s", 1), (2001, f"{prose(30, 5)} {passage}", "en", "s", 1),
                                 (2002, f"{prose(30, 6)} password = abcdefghijkl123", "en", "s", 1)]
    make_docs(rows, clashing=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = make_docs(rows, clashing=True)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS, name
    out = {r.doc_id: r for r in docs.collect()}
    assert {r[0] for r in clean} <= set(out) and {2, 3, 4, 5, 6} <= set(out)
    assert 2000 not in out and 2001 not in out and 2002 in out
    assert all(r.decoded_ok for r in out.values())
    assert docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count()


def test_redaction_changes_the_text_and_its_length(spark, make_docs):
    rows = [(1, "key password = abcdefghijkl123 end", "en", "s", 34), (2, "plain", "en", "s", None)]
    out = {r.doc_id: r for r in corpus_pipeline.without_secrets(spark, make_docs(rows), "").collect()}
    assert out[1].text == "key [secret] end" and out[1].n_chars == 16 and out[2].n_chars is None


def test_all_queries_are_registered():
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert DOCS and CLASHING
