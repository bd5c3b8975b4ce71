"""Queries: context blocks, prompts, demo catalogue, generation, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CONTEXT_DETAILS, GEN_STOP_SEQUENCES, GENERATION_ERROR_MESSAGE, NOT_AVAILABLE, PROMPT_MAX_CHARS
from ..functions import prompts as PR
from ..functions.text import SPACE, cut_at_first_stop
from ..operators.catalogue import search_catalogue
from ..operators.gram_index import build_gram_index, search_gram_index
from ..operators.generate import fallback_answer, generate_answers
from ..sources.tables import read_table
from . import retrieval
from .q_clean import META_CTE, sql_strip
from .q_search import DIM, RETRIEVAL_CTE, _bench_requests, _index
from ..sources.io import shared_folder
from .registry import register


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"


# -- shared: hits with metadata for the benchmark queries ----------------------

def hits_with_meta(spark, sf, k=5):
    meta, index = _index(spark, sf)
    return retrieval.retrieve(_bench_requests(spark, sf), index, meta, k=k, dim=DIM)


def _section_sql(pos: str) -> str:
    parts = [f"CAST({pos} AS VARCHAR) || '.'",
             f"CASE WHEN m.combined_text IS NOT NULL AND m.combined_text <> '' THEN {lit(PR.SECTION_PRODUCT)} || m.combined_text ELSE '' END"]
    for label, col in CONTEXT_DETAILS:
        v = f"m.{col}"
        disp = f"CASE WHEN length({v}) > 200 THEN substring({v}, 1, 200) || '...' ELSE {v} END"
        parts.append(f"CASE WHEN {v} IS NOT NULL AND {sql_strip(v)} <> '' AND {v} <> {lit(NOT_AVAILABLE)} "
                     f"THEN {lit(PR.SECTION_DETAIL.format(label=label))} || {disp} ELSE '' END")
    return " || ".join(parts)


def context_cte(max_chars=PROMPT_MAX_CHARS, max_items=None, group_expr=None) -> str:
    g = group_expr or "0"
    lim = f"WHERE pos <= {max_items}" if max_items else ""
    return (
        f"{RETRIEVAL_CTE},\n"
        f"pos AS (SELECT t.qid, t.text_query, {g} AS g, row_number() OVER (PARTITION BY t.qid, {g} ORDER BY t.rank) AS pos, "
        f"t.pid FROM top t),\n"
        f"sec AS (SELECT p.qid, p.g, p.pos, {_section_sql('p.pos')} AS section FROM pos p "
        f"JOIN meta m ON m.product_id = p.pid {lim}),\n"
        "run AS (SELECT *, sum(length(section)) OVER (PARTITION BY qid, g ORDER BY pos "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM sec),\n"
        f"ctx AS (SELECT qid, g, coalesce(string_agg(section, {NL} || {NL} ORDER BY pos) "
        f"FILTER (WHERE run <= {max_chars}), '') AS context FROM run GROUP BY qid, g),\n"
        "qs AS (SELECT qid, text_query FROM queries)")


def prompt_sql(q: str, ctx: str, examples=True, instructions=PR.DEFAULT_INSTRUCTIONS) -> str:
    parts = ([lit(PR.FEW_SHOT_EXAMPLES.strip())] if examples else []) + [
        lit(instructions), f"{lit(PR.USER_QUESTION)} || {q}", f"{lit(PR.CONTEXT_INTRO)} || {ctx}", lit(PR.PROMPT_CLOSING)]
    full = f"concat_ws({NL} || {NL}, {', '.join(parts)})"
    return f"CASE WHEN length({full}) > {PROMPT_MAX_CHARS} THEN {sql_strip(f'substring({full}, 1, {PROMPT_MAX_CHARS})')} ELSE {full} END"


def contexts(spark, sf, max_chars=PROMPT_MAX_CHARS, max_items=None):
    return PR.context_blocks(hits_with_meta(spark, sf), ["query_id"], max_chars=max_chars, max_items=max_items)


def _fallback_sql(p: str) -> str:
    from ..constants import FALLBACK_OTHER, FALLBACK_PRODUCT, FALLBACK_SEARCH_RESULTS
    return (f"CASE WHEN contains(lower({p}), 'search results:') THEN {lit(FALLBACK_SEARCH_RESULTS)} "
            f"WHEN contains(lower({p}), 'product') THEN {lit(FALLBACK_PRODUCT)} ELSE {lit(FALLBACK_OTHER)} END")


# -- X4, W3, L2 -----------------------------------------------------------------

@register("context", f"WITH {context_cte()} SELECT qid AS query_id, context FROM ctx")
def q_context(spark, sf):
    return contexts(spark, sf)


@register("context_budget", f"WITH {context_cte(1200, 4)} SELECT qid AS query_id, context FROM ctx")
def q_context_budget(spark, sf):
    return contexts(spark, sf, max_chars=1200, max_items=4)


# -- X5 --------------------------------------------------------------------------

@register("rag_prompt",
          f"WITH {context_cte()} SELECT qs.qid AS query_id, {prompt_sql('qs.text_query', 'ctx.context')} AS prompt "
          "FROM qs JOIN ctx USING (qid)")
def q_rag_prompt(spark, sf):
    c = contexts(spark, sf).join(_bench_requests(spark, sf), "query_id")
    return c.select("query_id", PR.rag_prompt(F.col("text_query"), F.col("context")).alias("prompt"))


# -- X6 --------------------------------------------------------------------------

@register("eval_prompt",
          f"WITH {context_cte()} SELECT qs.qid AS query_id, "
          f"{lit(PR.EVAL_HEADER + PR.EVAL_TASK + PR.EVAL_QUESTION)} || qs.text_query || {lit(PR.EVAL_PRODUCTS)} "
          f"|| ctx.context || {lit(PR.EVAL_ANSWER)} AS prompt FROM qs JOIN ctx USING (qid)")
def q_eval_prompt(spark, sf):
    c = contexts(spark, sf).join(_bench_requests(spark, sf), "query_id")
    return c.select("query_id", PR.evaluation_prompt(F.col("text_query"), F.col("context")).alias("prompt"))


# -- X7 --------------------------------------------------------------------------

@register("compare_prompt",
          f"WITH {context_cte(max_items=3, group_expr='(t.rank - 1) // 3')}, "
          f"grp AS (SELECT qid, string_agg('Group ' || CAST(g + 1 AS VARCHAR) || ':' || {NL} || context, "
          f"{NL} || {NL} ORDER BY g) AS groups FROM ctx GROUP BY qid) "
          f"SELECT qs.qid AS query_id, concat_ws({NL} || {NL}, {lit(PR.COMPARE_INTRO)}, "
          f"{lit(PR.COMPARE_QUERY)} || qs.text_query || {NL}, grp.groups, {lit(PR.COMPARE_CLOSING)}) AS prompt "
          "FROM qs JOIN grp USING (qid)")
def q_compare_prompt(spark, sf):
    h = hits_with_meta(spark, sf).withColumn("group_id", F.floor((F.col("rank") - 1) / 3).cast("long"))
    return PR.comparison_prompts(h, _bench_requests(spark, sf))


# -- X8 --------------------------------------------------------------------------

@register("explain_prompt",
          f"WITH {context_cte()} SELECT qs.qid AS query_id, "
          f"{prompt_sql(lit(PR.EXPLAIN_QUERY.split('{query}')[0]) + ' || qs.text_query', 'ctx.context', False, PR.EXPLAIN_DETAILED)} "
          "AS prompt FROM qs JOIN ctx USING (qid)")
def q_explain_prompt(spark, sf):
    c = contexts(spark, sf).join(_bench_requests(spark, sf), "query_id")
    return c.select("query_id", PR.explanation_prompt(F.col("text_query"), F.col("context")).alias("prompt"))


# -- N10 with the answer step (X5 -> X14 -> X11) ------------------------------------

@register("rag_answer",
          f"WITH {context_cte()}, pr AS (SELECT qs.qid, {prompt_sql('qs.text_query', 'ctx.context')} AS prompt "
          "FROM qs JOIN ctx USING (qid)) SELECT qid AS query_id, " + _fallback_sql("prompt") + " AS response FROM pr")
def q_rag_answer(spark, sf):
    c = contexts(spark, sf).join(_bench_requests(spark, sf), "query_id")
    p = c.select("query_id", PR.rag_prompt(F.col("text_query"), F.col("context")).alias("prompt"))
    return generate_answers(p).select("query_id", "response")


# -- C12, X9, X10, X14 ---------------------------------------------------------------

DEMO_EXPRS = [
    ("product_id", "p_partkey"), ("name", "p_name"), ("price", "p_retailprice"), ("category", "p_type"),
    ("description", "'Made by ' || p_brand || ', size ' || CAST(p_size AS STRING)"),
    ("url", "'https://shop.example.com/p/' || CAST(p_partkey AS STRING)"),
]
DEMO_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in DEMO_EXPRS) + " FROM part"
DEMO_QUERIES_SQL = ("SELECT DISTINCT w AS query FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) "
                    "UNION SELECT DISTINCT lower(p_type) FROM part "
                    "UNION SELECT DISTINCT split_part(p_name, ' ', 1) || ' under $50' FROM part")


def demo_products(spark, sf):
    return read_table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in DEMO_EXPRS])


def demo_queries(spark, sf):
    part = read_table(spark, sf, "part", ["p_name", "p_type"])
    words = part.select(F.explode(F.split("p_name", " ")).alias("query"))
    types = part.select(F.lower("p_type").alias("query"))
    cheap = part.select(F.concat(F.split("p_name", " ")[0], F.lit(" under $50")).alias("query"))
    q = words.unionByName(types).unionByName(cheap).distinct()
    return q.select(F.col("query").alias("query_id"), "query")


_CAT_MATCH = ("(contains(lower(p.name), lower(q.query)) OR contains(lower(p.description), lower(q.query)) "
              "OR contains(lower(p.category), lower(q.query)) "
              "OR (contains(lower(q.query), 'under $100') AND p.price < 100) "
              "OR (contains(lower(q.query), 'under $50') AND p.price < 50) "
              "OR (contains(lower(q.query), 'headphones') AND contains(lower(p.name), 'headphones')) "
              "OR (contains(lower(q.query), 'toys') AND contains(lower(p.category), 'toys')))")
CATALOGUE_CTE = (f"dp AS ({DEMO_SQL}), dq AS ({DEMO_QUERIES_SQL}), "
                 f"mt AS (SELECT q.query AS query_id, p.name, min(p.product_id) AS product_id FROM dp p, dq q "
                 f"WHERE {_CAT_MATCH} GROUP BY q.query, p.name), "
                 "rk AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS rank "
                 "FROM mt), res AS (SELECT rk.query_id, rk.rank, dp.* FROM rk JOIN dp USING (product_id) WHERE rk.rank <= 5)")


@register("catalogue_search",
          f"WITH {CATALOGUE_CTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, product_id, name FROM res")
def q_catalogue(spark, sf):
    r = search_catalogue(demo_products(spark, sf), demo_queries(spark, sf))
    return r.select("query_id", "rank", "product_id", "name")


@register("catalogue_index_search",
          f"WITH {CATALOGUE_CTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, product_id, name FROM res")
def q_catalogue_index(spark, sf):
    folder = build_gram_index(demo_products(spark, sf), shared_folder(spark, "gram-index"))
    r = search_gram_index(spark, folder, demo_queries(spark, sf))
    return r.select("query_id", "rank", "product_id", "name")


def _item_md(r):
    return (f"'**' || CAST({r}.rank AS VARCHAR) || '. ' || {r}.name || '**' || {NL} || {lit(chr(0x1F4B0) + ' Price: $')} "
            f"|| CAST({r}.price AS VARCHAR) || {NL} || {lit(chr(0x1F4C2) + ' Category: ')} || {r}.category || {NL} || "
            f"{lit(chr(0x1F4DD) + ' Description: ')} || {r}.description || {NL} || {lit(chr(0x1F517) + ' [View Product](')} "
            f"|| {r}.url || ')' || {NL} || {NL}")


def _item_pi(r):
    return (f"CAST({r}.rank AS VARCHAR) || '. Product: ' || {r}.name || ' | Price: $' || CAST({r}.price AS VARCHAR) "
            f"|| ' | Category: ' || {r}.category || {NL} || '   Description: ' || {r}.description || {NL}")


RENDER_CTE = (f"{CATALOGUE_CTE}, agg AS (SELECT query_id, string_agg({_item_md('res')}, '' ORDER BY rank) AS md, "
              f"string_agg({_item_pi('res')}, '' ORDER BY rank) AS pi FROM res GROUP BY query_id), "
              f"rendered AS (SELECT q.query AS query_id, CASE WHEN a.md IS NULL THEN {lit(PR.RESULTS_EMPTY)} "
              f"ELSE {lit(PR.RESULTS_HEADER)} || a.md END AS results_markdown, "
              f"CASE WHEN a.pi IS NULL THEN 'User asked: ' || q.query || {NL} || {NL} || "
              f"'No products found. Provide helpful suggestions.' ELSE 'User query: ' || q.query || {NL} || {NL} || "
              f"'Search results:' || {NL} || a.pi || {lit(PR.DEMO_PROMPT_TAIL)} END AS prompt "
              "FROM dq q LEFT JOIN agg a ON a.query_id = q.query)")


@register("render", f"WITH {RENDER_CTE} SELECT * FROM rendered")
def q_render(spark, sf):
    r = search_catalogue(demo_products(spark, sf), demo_queries(spark, sf))
    return PR.render_per_query(r, demo_queries(spark, sf))


@register("fallback", f"WITH {RENDER_CTE} SELECT query_id, {_fallback_sql('prompt')} AS response FROM rendered")
def q_fallback(spark, sf):
    r = search_catalogue(demo_products(spark, sf), demo_queries(spark, sf))
    p = PR.render_per_query(r, demo_queries(spark, sf))
    return p.select("query_id", fallback_answer("prompt").alias("response"))


# -- X15, X11 ---------------------------------------------------------------------------

@register("generate_batch",
          f"SELECT conv_id, turn, {_fallback_sql('text')} AS response FROM conversations")
def q_generate_batch(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return generate_answers(c, prompt_col="text").select("conv_id", "turn", "response")


_STOPS = GEN_STOP_SEQUENCES + ["."]


def _stop_sql(t: str) -> str:
    s = sql_strip(t)
    out = s
    for stop in reversed(_STOPS):
        out = f"CASE WHEN contains({s}, {lit(stop)}) THEN {sql_strip(f'split_part({s}, {lit(stop)}, 1)')} ELSE {out} END"
    return out


@register("stop_cut",
          f"SELECT conv_id, turn, {_stop_sql('text')} AS answer FROM conversations")
def q_stop_cut(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return c.select("conv_id", "turn", cut_at_first_stop("text", _STOPS).alias("answer"))


def _answer_or_fail(prompt, **params):
    """A caller's generator that fails on some prompts."""
    if len(prompt) % 7 == 3:
        raise RuntimeError("no answer")
    return f"{len(prompt)} characters, {params['max_tokens']} tokens at most"


@register("generate_custom",
          f"SELECT conv_id, turn, CASE WHEN length(text) % 7 = 3 THEN {lit(GENERATION_ERROR_MESSAGE)} "
          "ELSE length(text) || ' characters, 120 tokens at most' END AS response FROM conversations")
def q_generate_custom(spark, sf):
    """A caller's generator over Arrow batches; a row it fails on gets the apology."""
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "text"])
    return generate_answers(c, prompt_col="text", generate=_answer_or_fail, max_tokens=120).select("conv_id", "turn", "response")


# -- C13 -----------------------------------------------------------------------------------

def _words_sql(t: str) -> str:
    return f"CAST(len(list_filter(string_split_regex({sql_strip(t)}, '{SPACE}+'), lambda w: w <> '')) AS INTEGER)"


@register("token_cost",
          "WITH pr AS (SELECT u.conv_id, u.turn, u.text AS p, a.text AS r FROM conversations u JOIN conversations a "
          "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') "
          f"SELECT conv_id, turn, {_words_sql('p')} AS prompt_words, {_words_sql('r')} AS response_words, "
          f"round(({_words_sql('p')} + {_words_sql('r')}) * 0.0015 / 1000, 9) AS estimated_cost, "
          f"round({_words_sql('p')} * 0.0015 / 1000 + {_words_sql('r')} * 0.002 / 1000, 9) AS io_cost FROM pr")
def q_token_cost(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("p"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("r"))
    cols = PR.token_cost("p", "r")
    out = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", *cols)
    return out.select("conv_id", "turn", "prompt_words", "response_words",
                      F.round("estimated_cost", 9).alias("estimated_cost"), F.round("io_cost", 9).alias("io_cost"))


# -- C14 -----------------------------------------------------------------------------------

def _after_sql(marker: str) -> str:
    return (f"CASE WHEN contains(combined_text, {lit(marker)}) THEN "
            f"{sql_strip(f'split_part(split_part(combined_text, {lit(marker)}, 2), {lit(chr(124))}, 1)')} END")


@register("key_features",
          f"WITH {META_CTE}, f AS (SELECT product_id, 'price' AS feature, {_after_sql('Price:')} AS value FROM meta "
          f"UNION ALL SELECT product_id, 'category', {_after_sql('Category:')} FROM meta "
          f"UNION ALL SELECT product_id, 'shipping_weight', CASE WHEN shipping_weight <> '' AND shipping_weight <> "
          f"{lit(NOT_AVAILABLE)} THEN shipping_weight END FROM meta "
          f"UNION ALL SELECT product_id, 'dimensions', CASE WHEN product_dimensions <> '' AND product_dimensions <> "
          f"{lit(NOT_AVAILABLE)} THEN product_dimensions END FROM meta) SELECT * FROM f WHERE value IS NOT NULL")
def q_key_features(spark, sf):
    from .q_clean import metadata
    return PR.key_features(metadata(spark, sf)[0])
