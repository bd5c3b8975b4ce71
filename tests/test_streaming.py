import json
import os


from shelfwise.sources import io
from shelfwise.streaming.requests import read_stream_output, start_request_stream


def test_request_stream_serves_batches(spark):
    meta = spark.createDataFrame([(1, "Product Name: red mug | Category: Kitchen"),
                                  (2, "Product Name: blue plate | Category: Kitchen"),
                                  (3, "Product Name: green lamp | Category: Lighting")],
                                 "product_id long, combined_text string")
    from shelfwise.plans.retrieval import embed_products
    index = embed_products(meta, 16)
    req = io.shared_folder(spark, "req")
    os.makedirs(req)
    with open(os.path.join(req, "a.json"), "w") as f:
        f.write(json.dumps({"query_id": 1, "text_query": "red mug", "k": 2, "rerank": True}) + "\n")
        f.write(json.dumps({"query_id": 2, "text_query": "lamp", "k": 0, "rerank": False}) + "\n")
    out = io.shared_folder(spark, "resp")
    q = start_request_stream(spark, req, index, meta, out, dim=16)
    q.awaitTermination()
    assert q.exception() is None
    rows = read_stream_output(spark, out).orderBy("query_id", "rank").collect()
    ok = [r for r in rows if r.query_id == 1]
    assert [r.rank for r in ok] == [1, 2] and ok[0].product_id == 1
    bad = [r for r in rows if r.query_id == 2]
    assert len(bad) == 1 and bad[0].message.startswith("Error processing query: k must")
