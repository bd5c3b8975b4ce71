import json
import os

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ann
from shelfwise.plans import jobs
from shelfwise.sources import io
from shelfwise.sources.products import load_product_csv


def test_csv_load_null_tokens_and_multiline(spark, tmp_path):
    p = tmp_path / "products.csv"
    p.write_text('Uniq Id,Product Name,Category,About Product\n'
                 'a1,"Mug, large",N/A,"Line one\nline two"\n'
                 'a2,Plate,,NaN\n')
    df = load_product_csv(spark, str(p), ["Uniq Id", "Product Name", "Category", "About Product"]).orderBy("Uniq Id")
    rows = df.collect()
    assert rows[0]["Product Name"] == "Mug, large" and rows[0]["Category"] is None
    assert rows[0]["About Product"] == "Line one\nline two"
    assert rows[1]["Category"] is None and rows[1]["About Product"] is None


def test_write_modes(spark):
    df = spark.range(3)
    path = io.shared_folder(spark, "modes")
    io.write_table(df, path)
    with pytest.raises(Exception):
        io.write_table(df, path)
    io.write_table(df, path, force=True)
    assert spark.read.parquet(path).count() == 3


def test_index_save_load_and_eval_set(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "vec_id long, embedding array<float>, cluster_id int")
    path = io.save_index(v, io.shared_folder(spark, "idx"), {"dimension": 2, "index_type": "ivf"}, partition_col="cluster_id")
    vectors, cents, meta, man = io.load_index(spark, path)
    assert not man["is_trained"] and man["dimension"] == 2 and cents is None and meta is None
    assert (man["total_vectors"], man["vector_dimension"]) == (6, 2)
    with pytest.raises(ValueError, match="no trained IVF"):
        ann.load_ivf(spark, path)
    vectors.limit(1).write.mode("append").parquet(os.path.join(path, "vectors", "cluster_id=0"))
    with pytest.raises(ValueError, match="7 vectors where its manifest has 6"):
        io.load_index(spark, path)
    path = io.save_index(v, io.shared_folder(spark, "idx"), {"dimension": 2, "index_type": "ivf"}, partition_col="cluster_id",
                         centroids=spark.createDataFrame([(0, [0.0, 1.0]), (1, [5.0, 1.0])], "cluster_id long, centroid array<double>"))
    index = ann.load_ivf(spark, path)
    hits = ann.ivf_search(v.where("vec_id = 2").withColumnRenamed("vec_id", "query_id"), index, k=9, nprobe=1, prune=True)
    assert [r.vec_id for r in hits.orderBy("rank").collect()] == [2, 0, 4]
    plan = ann.restrict_to_probed(index, spark.createDataFrame([([0],)], "probes array<bigint>")).vectors
    assert "PartitionFilters: [isnotnull(cluster_id" in plan._jdf.queryExecution().executedPlan().toString()
    vectors = io.load_index(spark, path)[0]
    assert vectors.where("cluster_id = 1").count() == 3
    assert os.path.isdir(os.path.join(path, "vectors", "cluster_id=0"))
    ev = io.shared_folder(spark, "ev")
    os.makedirs(ev)
    with open(os.path.join(ev, "eval.json"), "w") as f:
        json.dump({"queries": ["q1", "q2"], "references": ["r1", "r2"]}, f, indent=2)
    got = io.load_eval_set(spark, ev, multi_line=True).orderBy("pos").collect()
    assert [(r.pos, r.query, r.reference) for r in got] == [(0, "q1", "r1"), (1, "q2", "r2")]


def test_process_and_build_jobs(spark, product_df):
    from shelfwise.sources.products import PRODUCT_COLUMNS
    cols = ["product_id"] + PRODUCT_COLUMNS
    src = io.write_table(product_df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]),
                         io.shared_folder(spark, "csv"), fmt="csv")
    out = io.shared_folder(spark, "job")
    paths = jobs.process_data(spark, src, out, columns=cols)
    assert spark.read.json(paths["metadata"]).count() == 2
    with pytest.raises(Exception):
        jobs.process_data(spark, src, out, columns=cols)
    idx = jobs.build_index(spark, paths["metadata"], os.path.join(out, "index"), dim=16)
    vectors, _, meta, man = io.load_index(spark, idx)
    assert vectors.count() == 2 and meta.count() == 2 and man["index_type"] == "flat"
