"""Queries: evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FALLBACK_OTHER, FALLBACK_PRODUCT, FALLBACK_SEARCH_RESULTS
from ..functions.scores import bleu_scores, rouge_l_column
from ..functions.text import SPACE, token_set
from ..operators import metrics as MX
from ..operators import search, sketches, truth
from ..operators.generate import generate_answers
from ..sources.io import materialise, shared_folder
from ..sources.tables import as_large, read_table
from .q_clean import META_CTE, WORD_RE, cleaned, sql_strip
from .q_search import DIM, hash_sql, hash_dist_sql
from .registry import register
from . import retrieval

KS = [1, 5, 10, 20]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- A6 ------------------------------------------------------------------------

@register("latency_stats",
          "SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, count(value) AS n, round(avg(value), 6) AS mean_latency_ms, "
          "round(quantile_cont(value, 0.5), 6) AS median_latency_ms, round(quantile_cont(value, 0.95), 6) AS p95_latency_ms, "
          "round(quantile_cont(value, 0.99), 6) AS p99_latency_ms, round(min(value), 6) AS min_latency_ms, "
          "round(max(value), 6) AS max_latency_ms, round(stddev_pop(value), 6) AS std_latency_ms "
          "FROM events GROUP BY ROLLUP (event_type)")
def q_latency(spark, sf):
    ev = read_table(spark, sf, "events", ["event_type", "value"])
    s = MX.latency_summary(ev, "value", ["event_type"], with_total=True)
    return s.select(F.when(F.col("is_total"), "all").otherwise(F.col("event_type")).alias("event_type"), "n",
                    *[MX.round_col(c) for c in s.columns if c.endswith("_ms")])


_SKETCH_PROBS = [0.5, 0.95, 0.99]


# A6 from stored sketches: every day but the last is added first, then the last one alone. ``close``
# says that the value's exact rank is within the stated error of the quantile asked for.
@register("latency_sketch",
          "WITH g AS (SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, count(value) AS n, "
          "round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high "
          "FROM events GROUP BY ROLLUP (event_type)) SELECT g.*, p, true AS close FROM g, "
          f"(SELECT unnest([{', '.join(map(str, _SKETCH_PROBS))}])::DOUBLE AS p)")
def q_latency_sketch(spark, sf):
    ev = read_table(spark, sf, "events", ["event_type", "ts", "value"]).withColumn("day", F.to_date("ts"))
    last = ev.agg(F.max("day")).first()[0]
    path = shared_folder(spark, "latency-days")
    for part in (ev.where(~F.col("day").eqNullSafe(F.lit(last))), ev.where(F.col("day").eqNullSafe(F.lit(last)))):
        sketches.add_days(part, path, "value", ["event_type"], "day")
    days = sketches.read_days(spark, path)
    total = sketches.merged(days, [], _SKETCH_PROBS).withColumn("event_type", F.lit("all"))
    both = materialise(sketches.merged(days, ["event_type"], _SKETCH_PROBS).unionByName(total), "latency-merged")
    asked = both.select("event_type", F.posexplode("quantiles").alias("i", "q")).withColumn(
        "p", F.element_at(F.array(*[F.lit(p) for p in _SKETCH_PROBS]), F.col("i") + 1))
    values = ev.select("value", F.explode(F.array(F.col("event_type"), F.lit("all"))).alias("event_type"))
    rank = values.join(F.broadcast(asked), "event_type").groupBy("event_type", "p").agg(
        F.avg((F.col("value") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("upto"))
    off = F.greatest(F.col("below") - F.col("p"), F.col("p") - F.col("upto"))
    return rank.select("event_type", "p", (off <= sketches.RANK_ERROR).alias("close")).join(both, "event_type").select(
        "event_type", "p", "n", *[MX.round_col(c) for c in ("mean", "std", "low", "high")], "close")


# -- A7, A8, A9 over the product index --------------------------------------------

def _eval_inputs(spark, sf, k=20):
    from .q_search import _index
    c = cleaned(spark, sf)
    meta, index = _index(spark, sf, c)
    hits = search.similar_items(index, k=k, tie_decimals=9)
    attrs = (as_large(c).join(as_large(meta.select("product_id")), "product_id")
             .select("product_id", F.col("Category").alias("category"), F.col("Product Name").alias("name")))
    a = attrs.select(F.col("product_id").alias("query_id"), F.col("category").alias("qc"), token_set("name").alias("qt"))
    b = attrs.select(F.col("product_id").alias("vec_id"), F.col("category").alias("cc"), token_set("name").alias("ct"))
    flagged = materialise(hits.join(as_large(a), "query_id").join(as_large(b), "vec_id")
               .withColumn("is_truth", truth.is_truth(F.col("qc"), F.col("qt"), F.col("cc"), F.col("ct"),
                                                      F.col("query_id"), F.col("vec_id")))
               .select("query_id", "rank", "vec_id", "is_truth"), "flagged-hits")
    prod = attrs.select("product_id", F.col("category").alias("Category"), F.col("name").alias("Product Name"))
    with_truth = truth.has_truth(prod).select(F.col("pid").alias("query_id"))
    return meta, flagged, with_truth, prod


def _eval_sql(k: int = 20) -> str:
    return (
        f"{META_CTE},\n{hash_sql('P', 'meta', 'product_id', 'combined_text')},\n"
        "dots AS (SELECT a.id AS qid, b.id AS pid, sum(a.c * b.c) AS dp FROM P_b a JOIN P_b b USING (b) "
        "WHERE a.id <> b.id GROUP BY ALL),\n"
        f"pairs AS (SELECT q.product_id AS qid, m.product_id AS pid, "
        f"{hash_dist_sql('qn', 'pn', 'q.product_id', 'm.product_id', 'd')} AS dist "
        "FROM meta q JOIN meta m ON q.product_id <> m.product_id "
        "LEFT JOIN P_n qn ON qn.id = q.product_id LEFT JOIN P_n pn ON pn.id = m.product_id "
        "LEFT JOIN dots d ON d.qid = q.product_id AND d.pid = m.product_id),\n"
        "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) AS rank FROM pairs) "
        f"WHERE rank <= {k}),\n"
        "attrs AS (SELECT c.product_id, c.\"Category\" AS category, "
        f"list_distinct(regexp_extract_all(lower(c.\"Product Name\"), '{WORD_RE}', 1)) AS toks "
        "FROM cleaned c JOIN meta m USING (product_id)),\n"
        "hit AS (SELECT r.qid, r.pid, r.rank, coalesce(a.category = b.category AND len(list_intersect(a.toks, b.toks)) >= 2, false) AS t "
        "FROM ranked r JOIN attrs a ON a.product_id = r.qid JOIN attrs b ON b.product_id = r.pid),\n"
        "tsize AS (SELECT a.product_id AS qid, count(*) AS n FROM attrs a JOIN attrs b ON a.category = b.category "
        "AND a.product_id <> b.product_id WHERE len(list_intersect(a.toks, b.toks)) >= 2 GROUP BY a.product_id),\n"
        "per AS (SELECT m.product_id AS qid, coalesce(ts.n, 0) AS tn, "
        + ", ".join(f"max(CASE WHEN h.t AND h.rank <= {kk} THEN 1 ELSE 0 END) AS h{kk}" for kk in KS)
        + ", min(CASE WHEN h.t AND h.rank <= 10 THEN h.rank END) AS fr, "
        "sum(CASE WHEN h.t AND h.rank <= 5 THEN 1 ELSE 0 END) AS ni, count(CASE WHEN h.rank <= 5 THEN 1 END) AS nr "
        "FROM meta m LEFT JOIN hit h ON h.qid = m.product_id LEFT JOIN tsize ts ON ts.qid = m.product_id "
        "GROUP BY m.product_id, ts.n),\n"
        "pr AS (SELECT *, CASE WHEN nr = 0 THEN 0.0 ELSE ni / nr END AS p, CASE WHEN tn = 0 THEN 0.0 ELSE ni / tn END AS r FROM per),\n"
        "f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)")


_RECALL_ROWS = " UNION ALL ".join(
    f"SELECT 'recall_scores' AS section, 'recall@{k}' AS metric, round(avg(h{k}), 6) AS value FROM f WHERE tn > 0"
    for k in KS)
_MRR_ROW = "SELECT 'recall_scores', 'mrr@10', round(avg(CASE WHEN fr IS NULL THEN 0.0 ELSE 1.0 / fr END), 6) FROM f WHERE tn > 0"
_PRF_ROWS = " UNION ALL ".join(
    f"SELECT 'retrieval_accuracy' AS section, '{name}' AS metric, round({agg}, 6) AS value FROM f" for name, agg in (
        ("precision", "avg(p)"), ("recall", "avg(r)"), ("f1", "avg(f1)"), ("precision_std", "stddev_pop(p)"),
        ("recall_std", "stddev_pop(r)"), ("f1_std", "stddev_pop(f1)")))


def _r6(df):
    return df.select("section", "metric", F.round("value", 6).alias("value"))


@register("recall_at_k", f"WITH {_eval_sql()} {_RECALL_ROWS} UNION ALL {_MRR_ROW}")
def q_recall(spark, sf):
    _, flagged, with_truth, _ = _eval_inputs(spark, sf)
    with_truth = materialise(with_truth, "with-truth")
    rec = MX.recall_rows(MX.recall_at_k(flagged, with_truth, KS))
    mrr = MX.mean_reciprocal_rank(flagged, with_truth, 10).select(
        F.lit("recall_scores").alias("section"), F.lit("mrr@10").alias("metric"), F.col("mrr").alias("value"))
    return _r6(rec.unionByName(mrr))


def _prf(spark, sf):
    meta, flagged, _, prod = _eval_inputs(spark, sf)
    sizes = truth.truth_sizes(prod)
    q = meta.select(F.col("product_id").alias("query_id"))
    return MX.metric_rows(MX.precision_recall_f1(flagged, q, sizes, 5), "retrieval_accuracy")


@register("prf1", f"WITH {_eval_sql()} {_PRF_ROWS}")
def q_prf1(spark, sf):
    return _r6(_prf(spark, sf))


# -- A15: comprehensive report --------------------------------------------------------

_STATS_ROWS = ("SELECT 'index_stats' AS section, 'total_vectors' AS metric, CAST(count(*) AS DOUBLE) AS value FROM meta UNION ALL "
               f"SELECT 'index_stats', 'dimension', {DIM}.0 UNION ALL "
               f"SELECT 'index_stats', 'memory_usage_mb', round(count(*) * {DIM} * 4 / (1024.0 * 1024.0), 6) FROM meta")


# Recorded durations carry no k: the event's number says which of the report's it stands for.
def _timed(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "value"])
    return ev.select("value", F.element_at(F.array(*[F.lit(k) for k in KS]), (F.pmod("event_id", F.lit(len(KS))) + 1).cast("int")).alias("k"))


_LATENCY_PARTS = {"mean_latency_ms": "avg(value)", "median_latency_ms": "quantile_cont(value, 0.5)",
                  "p95_latency_ms": "quantile_cont(value, 0.95)", "p99_latency_ms": "quantile_cont(value, 0.99)"}
_LATENCY_ROWS = " UNION ALL ".join(
    f"SELECT 'latency' AS section, '{name}@' || ([{', '.join(map(str, KS))}])[event_id % {len(KS)} + 1] AS metric, "
    f"round({sql}, 6) AS value FROM events GROUP BY event_id % {len(KS)}" for name, sql in _LATENCY_PARTS.items())


@register("comprehensive", f"WITH {_eval_sql()} {_STATS_ROWS} UNION ALL {_RECALL_ROWS} UNION ALL {_LATENCY_ROWS}")
def q_comprehensive(spark, sf):
    meta, flagged, with_truth, _ = _eval_inputs(spark, sf)
    index = retrieval.embed_products(meta, DIM)  # stats only need count and size: no search
    stats = MX.metric_rows(search.index_stats(index), "index_stats",
                           ["total_vectors", "dimension", "memory_usage_mb"])
    rec = MX.recall_rows(MX.recall_at_k(flagged, with_truth, KS))
    return _r6(stats.unionByName(rec).unionByName(MX.latency_rows(_timed(spark, sf), "value", "k", list(_LATENCY_PARTS))))


# -- A18: ablation over named configurations -----------------------------------------

ABLATION = [{"name": "top5", "k": 5}, {"k": 10}]


@register("ablation",
          f"WITH {_eval_sql()} "
          "SELECT 'top5' AS config_name, 'recall' AS metric, round(avg(h5), 6) AS value FROM f WHERE tn > 0 UNION ALL "
          "SELECT 'config_1', 'recall', round(avg(h10), 6) FROM f WHERE tn > 0")
def q_ablation(spark, sf):
    _, flagged, with_truth, _ = _eval_inputs(spark, sf)
    with_truth = materialise(with_truth, "with-truth")
    out = None
    for i, cfg in enumerate(ABLATION):
        r = MX.recall_at_k(flagged, with_truth, [cfg["k"]]).select(
            F.lit("recall").alias("metric"), F.round("recall", 6).alias("value"))
        r = MX.tag_config(r, cfg, i).select("config_name", "metric", "value")
        out = r if out is None else out.unionByName(r)
    return out


# -- X12, X13, A14, A16 ------------------------------------------------------------------

def _exchanges(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("reference"))
    return u.join(a, ["conv_id", "turn"]).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))


def _words(t: str) -> str:
    return f"list_filter(string_split_regex({sql_strip(t)}, '{SPACE}+'), lambda w: w <> '')"


def _bleu_sql(src: str, id_expr: str, ref: str, hyp: str) -> str:
    def grams(col, name):
        return (f"{name} AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, unnest(list_transform("
                f"range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g "
                f"FROM (SELECT {id_expr} AS id, {_words(col)} AS w FROM {src}) x, range(1, 5) r(n)) GROUP BY ALL)")
    p = " * ".join(f"(CASE WHEN m{i} > 0 THEN m{i} / greatest(c - {i} + 1, 1) "
                   f"ELSE 1.0 / (pow(2, z{i}) * 5 / ln(c)) / greatest(c - {i} + 1, 1) END)" for i in range(1, 5))
    zs = ", ".join(f"({' + '.join(f'CASE WHEN m{j} = 0 THEN 1 ELSE 0 END' for j in range(1, i + 1))}) AS z{i}"
                   for i in range(1, 5))
    return (
        f"lens AS (SELECT {id_expr} AS id, len({_words(ref)}) AS r, len({_words(hyp)}) AS c FROM {src}),\n"
        f"{grams(hyp, 'hg')},\n{grams(ref, 'rg')},\n"
        "mm AS (SELECT hg.id, " + ", ".join(
            f"sum(CASE WHEN hg.n = {i} THEN least(hg.c, coalesce(rg.c, 0)) ELSE 0 END) AS m{i}" for i in range(1, 5))
        + " FROM hg LEFT JOIN rg ON rg.id = hg.id AND rg.n = hg.n AND rg.g = hg.g GROUP BY hg.id),\n"
        f"bz AS (SELECT lens.id, lens.r, lens.c, " + ", ".join(f"coalesce(mm.m{i}, 0) AS m{i}" for i in range(1, 5))
        + " FROM lens LEFT JOIN mm USING (id)),\n"
        f"bz2 AS (SELECT *, {zs} FROM bz),\n"
        "bl AS (SELECT id, CASE WHEN c = 0 OR m1 = 0 THEN 0.0 "
        "WHEN c = 1 AND (m2 = 0 OR m3 = 0 OR m4 = 0) THEN 0.0 "
        f"ELSE (CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END) * pow({p}, 0.25) END AS bleu FROM bz2)")


EXCH_SQL = ("ex AS (SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS question, a.text AS reference "
            "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
            "WHERE u.role = 'user' AND a.role = 'assistant')")


@register("bleu", f"WITH {EXCH_SQL}, {_bleu_sql('ex', 'pair_id', 'reference', 'question')} "
                  "SELECT id AS pair_id, round(bleu, 6) AS bleu FROM bl")
def q_bleu(spark, sf):
    ex = _exchanges(spark, sf)
    b = bleu_scores(ex, "pair_id", "reference", "question")
    return b.select("pair_id", F.round("bleu", 6).alias("bleu"))


@register("rouge_l")
def q_rouge(spark, sf):
    ex = _exchanges(spark, sf)
    return ex.select("pair_id", F.round(rouge_l_column("reference", "question"), 6).alias("rouge_l"))


def _lcs_sql(src: str, id_expr: str, ref: str, gen: str) -> str:
    """rl(id, rouge): ROUGE-L F1 without stems, by the textbook table, a row a step."""
    toks = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
    return (
        f"lt AS (SELECT {id_expr} AS id, {toks(ref)} AS f, {toks(gen)} AS g FROM {src}),\n"
        "lcs AS (SELECT id, 0 AS i, list_transform(range(0, len(f) + 1), lambda j: CAST(0 AS BIGINT)) AS dp, f, g FROM lt "
        "UNION ALL SELECT id, i + 1, list_transform(range(0, len(f) + 1), lambda j: list_max(list_transform(range(0, j + 1), "
        "lambda k: CASE WHEN k > 0 AND f[k] = g[i + 1] THEN dp[k] + 1 ELSE dp[k + 1] END))), f, g FROM lcs WHERE i < len(g)),\n"
        "rl AS (SELECT id, CASE WHEN len(f) = 0 OR len(g) = 0 OR dp[len(f) + 1] = 0 THEN 0.0 "
        "ELSE 2 * (dp[len(f) + 1] / len(g)) * (dp[len(f) + 1] / len(f)) / (dp[len(f) + 1] / len(g) + dp[len(f) + 1] / len(f)) END AS rouge "
        "FROM lcs WHERE i = len(g))")


@register("rouge_l_plain", f"WITH RECURSIVE {EXCH_SQL}, {_lcs_sql('ex', 'pair_id', 'reference', 'question')} "
          "SELECT id AS pair_id, round(rouge, 6) AS rouge_l FROM rl")
def q_rouge_plain(spark, sf):
    ex = _exchanges(spark, sf)
    return ex.select("pair_id", F.round(rouge_l_column("reference", "question", stem=False), 6).alias("rouge_l"))


def _generated(spark, sf):
    ex = _exchanges(spark, sf)
    return generate_answers(ex, prompt_col="question", out_col="generated")


_FB = (f"CASE WHEN contains(lower(question), 'search results:') THEN {lit(FALLBACK_SEARCH_RESULTS)} "
       f"WHEN contains(lower(question), 'product') THEN {lit(FALLBACK_PRODUCT)} ELSE {lit(FALLBACK_OTHER)} END")


@register("answer_bleu",
          f"WITH {EXCH_SQL}, g AS (SELECT pair_id, reference, {_FB} AS generated FROM ex), "
          f"{_bleu_sql('g', 'pair_id', 'reference', 'generated')} "
          "SELECT round(avg(bleu), 6) AS bleu_mean, round(stddev_pop(bleu), 6) AS bleu_std, count(*) AS n FROM bl")
def q_answer_bleu(spark, sf):
    g = _generated(spark, sf)
    b = bleu_scores(g, "pair_id", "reference", "generated")
    return b.agg(F.round(F.avg("bleu"), 6).alias("bleu_mean"), F.round(F.stddev_pop("bleu"), 6).alias("bleu_std"),
                 F.count(F.lit(1)).alias("n"))


@register("response_quality")
def q_response_quality(spark, sf):
    g = _generated(spark, sf)
    q = MX.response_quality(MX.response_scores(g, "pair_id", "reference", "generated"))
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


_QUALITY_CTE = (f"{EXCH_SQL}, g AS (SELECT pair_id, reference, {_FB} AS generated FROM ex), "
                f"{_bleu_sql('g', 'pair_id', 'reference', 'generated')}, "
                f"{_lcs_sql('g', 'pair_id', 'reference', 'generated')}")
_QUALITY = (("bleu_mean", "avg(bleu)", "bl"), ("bleu_std", "stddev_pop(bleu)", "bl"),
            ("rouge_mean", "avg(rouge)", "rl"), ("rouge_std", "stddev_pop(rouge)", "rl"))


@register("response_quality_plain", f"WITH RECURSIVE {_QUALITY_CTE} SELECT "
          + ", ".join(f"(SELECT round({agg}, 6) FROM {t}) AS {name}" for name, agg, t in _QUALITY))
def q_response_quality_plain(spark, sf):
    g = _generated(spark, sf)
    q = MX.response_quality(MX.response_scores(g, "pair_id", "reference", "generated", stem=False))
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


def _end_to_end(spark, sf, stem: bool):
    ev = read_table(spark, sf, "events", ["value"])
    lat = MX.metric_rows(MX.latency_summary(ev, "value").drop("n"), "latency")
    g = _generated(spark, sf)
    qual = MX.metric_rows(MX.response_quality(MX.response_scores(g, "pair_id", "reference", "generated", stem)),
                          "response_quality")
    return _r6(lat.unionByName(qual).unionByName(_prf(spark, sf)))


@register("end_to_end")
def q_end_to_end(spark, sf):
    return _end_to_end(spark, sf, stem=True)


_LATENCY = (("mean_latency_ms", "avg(value)"), ("median_latency_ms", "quantile_cont(value, 0.5)"),
            ("p95_latency_ms", "quantile_cont(value, 0.95)"), ("p99_latency_ms", "quantile_cont(value, 0.99)"),
            ("min_latency_ms", "min(value)"), ("max_latency_ms", "max(value)"), ("std_latency_ms", "stddev_pop(value)"))


@register("end_to_end_plain", f"WITH RECURSIVE {_eval_sql()}, {_QUALITY_CTE} "
          + " UNION ALL ".join([f"SELECT 'latency' AS section, '{n}' AS metric, round({agg}, 6) AS value FROM events" for n, agg in _LATENCY]
                               + [f"SELECT 'response_quality', '{n}', round({agg}, 6) FROM {t}" for n, agg, t in _QUALITY])
          + f" UNION ALL {_PRF_ROWS}")
def q_end_to_end_plain(spark, sf):
    return _end_to_end(spark, sf, stem=False)
