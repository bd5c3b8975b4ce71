"""Queries: vector functions and embedding metrics.

Two "modalities" come from the embeddings table: a vector and the vector of
the next id (``vec_id + 1``; the last id has none, so null handling shows).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import hash_embed
from ..operators import vector_metrics as M
from ..operators.clean import global_position
from ..sources.tables import read_table
from .q_search import DIM, hash_sql
from .registry import register


def r6arr(c):
    return F.transform(c, lambda x: F.round(x, 6))


def modal_pairs(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    img = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("image"))
    return e.select("vec_id", "label", F.col("embedding").alias("text")).join(img, "vec_id", "left")


def full_pairs(spark, sf):
    """Pairs in which a vector without a partner has itself backwards for one."""
    return modal_pairs(spark, sf).withColumn("image", F.coalesce("image", F.reverse("text")))


FULL_CTE = ("p AS (SELECT a.vec_id, a.label, a.embedding::DOUBLE[] AS t, "
            "coalesce(b.embedding, list_reverse(a.embedding))::DOUBLE[] AS m "
            "FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
PAIRS_CTE = ("p AS (SELECT a.vec_id, a.label, a.embedding::DOUBLE[] AS t, b.embedding::DOUBLE[] AS m "
             "FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)")


def s_r6(x: str) -> str:
    return f"list_transform({x}, lambda z: round(z, 6))"


def s_norm(x: str) -> str:
    return f"sqrt(list_sum(list_transform({x}, lambda z: z * z)))"


def s_normalize(x: str) -> str:
    return f"CASE WHEN {s_norm(x)} > 0 THEN list_transform({x}, lambda z: z / {s_norm(x)}) ELSE {x} END"


def s_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda q: q[1] * q[2]))"


def s_wsum(a: str, b: str, wa: str, wb: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda q: q[1] * {wa} + q[2] * {wb})"


NP_CTE = (f"{PAIRS_CTE}, n AS (SELECT vec_id, label, t, m, {s_normalize('t')} AS nt, "
          f"CASE WHEN m IS NOT NULL THEN {s_normalize('m')} END AS nm FROM p)")


FULL_NP_CTE = NP_CTE.replace(PAIRS_CTE, FULL_CTE)


# -- V4, V5 -------------------------------------------------------------------

@register("normalize",
          "WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda z: z * (label + 1)) AS v FROM embeddings) "
          f"SELECT vec_id, {s_r6(s_normalize('v'))} AS embedding FROM s")
def q_normalize(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    scaled = F.transform(V.as_double("embedding"), lambda x: x * (F.col("label") + 1))
    return e.select("vec_id", r6arr(V.l2_normalize(scaled)).alias("embedding"))


@register("pad_cut",
          "SELECT vec_id, list_transform(embedding[1:48], lambda z: round(z::DOUBLE, 6)) AS cut48, "
          "list_transform(list_concat(embedding::DOUBLE[], list_transform(range(16), lambda i: 0.0::DOUBLE)), "
          "lambda z: round(z, 6)) AS pad80 FROM embeddings")
def q_pad(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return e.select("vec_id", r6arr(V.pad_or_cut("embedding", 48)).alias("cut48"),
                    r6arr(V.pad_or_cut("embedding", 80)).alias("pad80"))


# -- V2, V3 -------------------------------------------------------------------

@register("average_raw",
          f"WITH {PAIRS_CTE} SELECT vec_id, CASE WHEN m IS NULL THEN {s_r6('t')} "
          f"ELSE {s_r6(s_wsum('t', 'm', '0.5', '0.5'))} END AS embedding FROM p")
def q_average(spark, sf):
    p = modal_pairs(spark, sf)
    return p.select("vec_id", r6arr(V.average("text", "image")).alias("embedding"))


@register("concat_raw",
          f"WITH {FULL_CTE} SELECT vec_id, {s_r6('list_concat(t, m)')} AS embedding FROM p")
def q_concat_raw(spark, sf):
    p = full_pairs(spark, sf)
    return p.select("vec_id", r6arr(V.concat_raw("text", "image")).alias("embedding"))


# -- V6-V9 ---------------------------------------------------------------------

def _fuse_query(method, weights):
    def run(spark, sf):
        p = full_pairs(spark, sf)
        f = V.fuse_columns(p, ["text", "image"], "fused", list(weights), method)
        return f.select("vec_id", r6arr(F.col("fused")).alias("embedding"))
    return run


register("fuse_avg",
         f"WITH {FULL_NP_CTE}, f AS (SELECT vec_id, {s_wsum('nt', 'nm', '0.5', '0.5')} AS v FROM n) "
         f"SELECT vec_id, {s_r6(s_normalize('v'))} AS embedding FROM f")(_fuse_query("weighted_average", (0.5, 0.5)))

register("fuse_concat",
         f"WITH {FULL_NP_CTE} SELECT vec_id, {s_r6('list_concat(nt, nm)')} AS embedding FROM n")(
    _fuse_query("concatenate", (0.5, 0.5)))

register("fuse_max",
         f"WITH {FULL_NP_CTE} SELECT vec_id, {s_r6('list_transform(list_zip(nt, nm), lambda q: greatest(q[1], q[2]))')} "
         "AS embedding FROM n")(_fuse_query("max_pooling", (0.5, 0.5)))

_ATT = (f"{FULL_NP_CTE}, s AS (SELECT vec_id, nt, nm, {s_dot('nt', 'nm')} * 0.3 AS s0, {s_dot('nt', 'nm')} * 0.7 AS s1 "
        "FROM n), "
        "a AS (SELECT vec_id, nt, nm, exp(s0 - greatest(s0, s1)) AS e0, exp(s1 - greatest(s0, s1)) AS e1 FROM s), "
        f"f AS (SELECT vec_id, {s_wsum('nt', 'nm', 'e0 / (e0 + e1)', 'e1 / (e0 + e1)')} AS v FROM a)")
register("fuse_attention", f"WITH {_ATT} SELECT vec_id, {s_r6(s_normalize('v'))} AS embedding FROM f")(
    _fuse_query("attention_weighted", (0.7, 0.3)))


# -- V10 -----------------------------------------------------------------------

@register("hybrid",
          f"WITH {FULL_NP_CTE}, h AS (SELECT vec_id, nt, nm AS pm FROM n), "
          f"h2 AS (SELECT vec_id, nt, {s_normalize('pm')} AS npm FROM h), "
          f"h3 AS (SELECT vec_id, nt, {s_normalize('npm')} AS npm2 FROM h2), "
          f"f AS (SELECT vec_id, {s_wsum('nt', 'npm2', '0.6', '0.4')} AS v FROM h3) "
          f"SELECT vec_id, {s_r6(s_normalize('v'))} AS embedding FROM f")
def q_hybrid(spark, sf):
    p = full_pairs(spark, sf).withColumn("second", V.l2_normalize("image"))
    f = V.hybrid_columns(p, "text", "second", "fused", DIM)
    return f.select("vec_id", r6arr(F.col("fused")).alias("embedding"))


# -- V11, V12 --------------------------------------------------------------------

def _present_sql(wa, wb):
    return (f"WITH {NP_CTE}, f AS (SELECT vec_id, nt, nm, {s_wsum('nt', 'nm', wa, wb)} AS v FROM n) "
            f"SELECT vec_id, CASE WHEN nm IS NULL THEN {s_r6('nt')} ELSE {s_r6(s_normalize('v'))} END AS embedding FROM f")


@register("multimodal", _present_sql("0.5", "0.5"))
def q_multimodal(spark, sf):
    f = V.fuse_present_columns(modal_pairs(spark, sf), "text", "image", "fused", 0.5, 0.5)
    return f.select("vec_id", r6arr(F.col("fused")).alias("embedding"))


@register("product_vec", _present_sql("0.7", "0.3"))
def q_product_vec(spark, sf):
    f = V.fuse_present_columns(modal_pairs(spark, sf), "text", "image", "fused", 0.7, 0.3)
    return f.select("vec_id", r6arr(F.col("fused")).alias("embedding"))


# -- V13 -----------------------------------------------------------------------

@register("similarity",
          f"WITH {FULL_CTE} SELECT vec_id, round({s_dot('t', 'm')} / ({s_norm('t')} * {s_norm('m')}), 6) AS cosine, "
          "round(1.0 / (1.0 + sqrt(list_sum(list_transform(list_zip(t, m), lambda q: (q[1] - q[2]) * (q[1] - q[2]))))), 6) "
          f"AS euclidean, round({s_dot('t', 'm')}, 6) AS dot FROM p")
def q_similarity(spark, sf):
    p = full_pairs(spark, sf)
    return p.select("vec_id", *[F.round(V.similarity("text", "image", m), 6).alias(m)
                                for m in ("cosine", "euclidean", "dot")])


# -- A2 ------------------------------------------------------------------------

@register("embedding_quality",
          "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), "
          f"nr AS (SELECT {s_norm('v')} AS nrm FROM e), "
          "pr AS (SELECT list_inner_product(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), "
          "ns AS (SELECT count(*) AS n, round(avg(nrm), 6) AS norm_mean, round(stddev_pop(nrm), 6) AS norm_std, "
          "round(min(nrm), 6) AS norm_min, round(max(nrm), 6) AS norm_max FROM nr), "
          "ps AS (SELECT round(avg(d), 6) AS sim_mean, round(stddev_pop(d), 6) AS sim_std, round(min(d), 6) AS sim_min, "
          "round(max(d), 6) AS sim_max, round(1 - avg(d), 6) AS diversity_score FROM pr) "
          "SELECT n AS num_embeddings, 64 AS embedding_dim, norm_mean, norm_std, norm_min, norm_max, "
          "sim_mean, sim_std, sim_min, sim_max, diversity_score FROM ns, ps")
def q_embedding_quality(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    q = M.embedding_quality(e)
    return q.select("num_embeddings", "embedding_dim",
                    *[F.round(c, 6).alias(c) for c in q.columns[2:]])


# -- A3 ------------------------------------------------------------------------

@register("fusion_quality",
          f"WITH halves AS (SELECT doc_id, substring(text, CAST(length(text) // 2 AS INTEGER) + 1) AS half FROM documents), "
          f"{hash_sql('D', 'documents', 'doc_id', 'text')}, {hash_sql('H', 'halves', 'doc_id', 'half')}, "
          "dots AS (SELECT a.id AS doc_id, sum(a.c * b.c) AS dp FROM D_b a JOIN H_b b ON a.id = b.id AND a.b = b.b GROUP BY a.id), "
          "pred AS (SELECT l.doc_id, l.quality, CASE WHEN n.nrm > 0 AND h.nrm > 0 THEN coalesce(dots.dp, 0) / (n.nrm * h.nrm) END AS cs "
          "FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN dots ON dots.doc_id = l.doc_id "
          "LEFT JOIN D_n n ON n.id = l.doc_id LEFT JOIN H_n h ON h.id = l.doc_id) "
          "SELECT round(corr(cs, quality), 6) AS correlation, round(avg((cs - quality) * (cs - quality)), 6) AS mse, "
          "round(avg(abs(cs - quality)), 6) AS mae FROM pred")
def q_fusion_quality(spark, sf):
    """Every label with its own document: the vector of the whole text against that of
    its second half."""
    labels = read_table(spark, sf, "labels", ["doc_id", "quality"])
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    half = F.substr("text", (F.floor(F.length("text") / 2) + 1).cast("int"))
    pairs = labels.join(docs, "doc_id").select(
        "quality", hash_embed("text", DIM).alias("a"), hash_embed(half, DIM).alias("b"))
    r = M.fusion_quality(pairs, "a", "b", "quality")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


# -- A10 -----------------------------------------------------------------------

@register("top1_top5",
          "WITH t AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), "
          "i AS (SELECT a.vec_id AS id, coalesce(b.embedding::DOUBLE[], list_transform(range(64), lambda z: 0.0::DOUBLE)) AS v "
          "FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1), "
          "s AS (SELECT t.id AS tid, i.id AS iid, round(list_inner_product(t.v, i.v), 12) AS sc FROM t, i), "
          "r AS (SELECT tid, iid, row_number() OVER (PARTITION BY tid ORDER BY sc DESC, iid DESC) AS rk FROM s) "
          "SELECT avg(CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END) AS accuracy_top1, "
          "avg(CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END) AS accuracy_top5, count(*) AS num_pairs FROM r WHERE tid = iid")
def q_top1_top5(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    texts = e.select(F.col("vec_id").alias("id"), "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("id"), "embedding")
    images = e.select(F.col("vec_id").alias("id")).join(nxt, "id", "left")
    truth = e.select(F.col("vec_id").alias("text_id"), F.col("vec_id").alias("image_id"))
    r = M.similarity_accuracy(texts, images, truth, DIM)
    return r.select(F.round("accuracy_top1", 6).alias("accuracy_top1"),
                    F.round("accuracy_top5", 6).alias("accuracy_top5"), "num_pairs")


# -- A11 -----------------------------------------------------------------------

@register("dispersion",
          "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), "
          "c AS (SELECT label, count(*) AS n FROM e GROUP BY label), "
          "d AS (SELECT a.label, sum(list_distance(a.v, b.v)) AS s FROM e a JOIN e b USING (label) GROUP BY a.label), "
          "m AS (SELECT c.label, c.n, coalesce(d.s, 0) / (c.n * c.n) AS md FROM c LEFT JOIN d USING (label)) "
          "SELECT round(sum(CASE WHEN n > 1 THEN md ELSE 0 END) / count(*), 6) AS category_loss, "
          "count(*) AS n_categories FROM m")
def q_dispersion(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    r = M.category_dispersion(e, "label", block_rows=16)
    return r.select(F.round("category_loss", 6).alias("category_loss"), "n_categories")


# -- A12, A13 --------------------------------------------------------------------

_BATCH = 16


@register("contrastive",
          "WITH b0 AS (SELECT a.vec_id, a.label, a.embedding::DOUBLE[] AS t, "
          "coalesce(b.embedding, list_reverse(a.embedding))::DOUBLE[] AS m, "
          f"(row_number() OVER (ORDER BY a.vec_id) - 1) // {_BATCH} AS batch_id "
          "FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1), "
          f"n AS (SELECT vec_id, label, batch_id, t, {s_normalize('t')} AS tn, {s_normalize('m')} AS mn FROM b0), "
          "lg AS (SELECT x.batch_id, x.vec_id AS i, y.vec_id AS j, list_inner_product(x.tn, y.mn) / 0.07 AS l "
          "FROM n x JOIN n y USING (batch_id)), "
          "rm AS (SELECT batch_id, i, max(l) AS mx FROM lg GROUP BY ALL), "
          "cm AS (SELECT batch_id, j, max(l) AS mx FROM lg GROUP BY ALL), "
          "rl AS (SELECT lg.batch_id, lg.i, rm.mx + ln(sum(exp(lg.l - rm.mx))) AS lse FROM lg JOIN rm USING (batch_id, i) "
          "GROUP BY lg.batch_id, lg.i, rm.mx), "
          "cl AS (SELECT lg.batch_id, lg.j, cm.mx + ln(sum(exp(lg.l - cm.mx))) AS lse FROM lg JOIN cm USING (batch_id, j) "
          "GROUP BY lg.batch_id, lg.j, cm.mx), "
          "dg AS (SELECT batch_id, i, l FROM lg WHERE i = j), "
          "ce AS (SELECT dg.batch_id, (avg(rl.lse - dg.l) + avg(cl.lse - dg.l)) / 2 AS contrastive_loss, count(*) AS n "
          "FROM dg JOIN rl ON rl.batch_id = dg.batch_id AND rl.i = dg.i JOIN cl ON cl.batch_id = dg.batch_id AND cl.j = dg.i "
          "GROUP BY dg.batch_id), "
          "cc AS (SELECT batch_id, label, count(*) AS nc FROM n GROUP BY ALL), "
          "cd AS (SELECT x.batch_id, x.label, sum(list_distance(x.t, y.t)) AS s FROM n x JOIN n y "
          "ON x.batch_id = y.batch_id AND x.label = y.label GROUP BY ALL), "
          "cat AS (SELECT cc.batch_id, sum(CASE WHEN cc.nc > 1 THEN cd.s / (cc.nc * cc.nc) ELSE 0 END) / count(*) AS category_loss "
          "FROM cc JOIN cd USING (batch_id, label) GROUP BY cc.batch_id) "
          "SELECT batch_id, n, round(contrastive_loss, 6) AS contrastive_loss, round(category_loss, 6) AS category_loss, "
          "round(contrastive_loss + 0.1 * category_loss, 6) AS total_loss FROM ce JOIN cat USING (batch_id)")
def q_contrastive(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nx"))
    pairs = (e.join(nxt, "vec_id", "left")
             .select("vec_id", "label", F.col("embedding").alias("text"),
                     F.coalesce("nx", F.reverse("embedding")).alias("image")))
    pos = global_position(pairs, "vec_id").withColumn("batch_id", F.floor(F.col("position") / _BATCH).cast("long"))
    r = M.batch_losses(pos, "batch_id", "text", "image", "label")
    return r.select("batch_id", "n", *[F.round(c, 6).alias(c) for c in ("contrastive_loss", "category_loss", "total_loss")])
