from shelfwise.operators.search import similar_items
from shelfwise.plans.retrieval import batch_retrieve, embed_products, retrieve

CATALOGUE = [
    (1, "Product Name: red ceramic mug | Category: Kitchen"),
    (2, "Product Name: blue ceramic plate | Category: Kitchen"),
    (3, "Product Name: green desk lamp | Category: Lighting"),
    (4, "Product Name: red desk lamp | Category: Lighting"),
]


def _setup(spark):
    meta = spark.createDataFrame(CATALOGUE, "product_id long, combined_text string")
    return meta, embed_products(meta, 32)


def test_retrieve_and_rerank(spark):
    meta, index = _setup(spark)
    req = spark.createDataFrame([(1, "red desk lamp")], "query_id long, text_query string")
    hits = retrieve(req, index, meta, k=3, dim=32).orderBy("rank").collect()
    assert hits[0].product_id == 4 and len(hits) == 3
    rr = retrieve(req, index, meta, k=3, dim=32, rerank=True).orderBy("rank").collect()
    assert [r.overlap for r in rr] == sorted([r.overlap for r in rr], reverse=True)
    assert all(r.score == 0.0 for r in rr) and {r.orig_rank for r in rr} == {1, 2, 3}


def test_batch_retrieve_per_request_k_and_errors(spark):
    meta, index = _setup(spark)
    req = spark.createDataFrame([(1, "ceramic", 2, False), (2, "lamp", 1, True), (3, None, 3, False),
                                 (4, "mug", 60, False)], "query_id long, text_query string, k int, rerank boolean")
    out = batch_retrieve(req, index, meta, dim=32).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r)
    assert len(by[1]) == 2 and len(by[2]) == 1 and by[2][0].score == 0.0
    assert by[3][0].rank is None and by[3][0].message == "Error processing query: no text or image query"
    assert by[4][0].message.startswith("Error processing query: k must be in 1..50")


def test_similar_items_exclude_self(spark):
    _, index = _setup(spark)
    got = similar_items(index, k=2).collect()
    assert all(r.query_id != r.vec_id for r in got) and len(got) == 8
