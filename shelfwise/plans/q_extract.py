"""Queries: field extraction by pattern table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FIELD_QUERY_INDICATORS, FUZZY_THRESHOLD, NOT_AVAILABLE
from ..functions import extract as X
from ..functions.text import SPACE
from ..operators import clean
from ..operators import many_patterns as MP
from ..sources.tables import read_table
from .q_clean import CLEANED_CTE, COMBINED_SQL, cleaned, sql_strip
from .registry import ORACLES, register

# Our own question wording, one template per product (picked by id), so every
# field pattern, the fuzzy path and non-field questions all occur.
QUESTION_TEMPLATES = [
    "what is the price of the {}", "how much does the {} cost", "what size is the {}",
    "tell me the weight of the {}", "which brand makes the {}", "what color is the {}",
    "model number of the {}", "is the {} right for my kids age", "what battery power does the {} need",
    "what material is the {} made of", "rating score of the {}", "shipping and delivery of the {}",
    "color colour colors colours", "{}",
]


def _question_sql(id_expr: str, name_expr: str) -> str:
    whens = []
    for i, t in enumerate(QUESTION_TEMPLATES):
        pre, _, post = t.partition("{}")
        if "{}" in t:
            e = " || ".join(x for x in ([f"'{pre}'"] if pre else []) + [name_expr] + ([f"'{post}'"] if post else []))
        else:
            e = f"'{t}'"
        whens.append(f"WHEN {i} THEN {e}")
    return f"CASE {id_expr} % {len(QUESTION_TEMPLATES)} " + " ".join(whens) + " END"


_NA = f"'{NOT_AVAILABLE}'"


def _detail_sql(q) -> str:
    return (f"concat_ws(' | ', {COMBINED_SQL}, "
            f"CASE WHEN {q('Product Specification')} <> {_NA} THEN {q('Product Specification')} END, "
            f"CASE WHEN {q('Technical Details')} <> {_NA} THEN {q('Technical Details')} END, "
            f"CASE WHEN {q('Shipping Weight')} <> {_NA} THEN 'Shipping Weight: ' || {q('Shipping Weight')} END, "
            f"CASE WHEN {q('Product Dimensions')} <> {_NA} THEN 'Product Dimensions: ' || {q('Product Dimensions')} END, "
            f"'Brand: ' || split_part({q('Product Name')}, ' ', 1))")


def _duck(n):
    return f'"{n}"'


INPUT_CTE = (f"{CLEANED_CTE},\nx AS (SELECT product_id, \"Category\" AS category, "
             f"{_question_sql('product_id', chr(34) + 'Product Name' + chr(34))} AS question, "
             f"{_detail_sql(_duck)} AS text FROM cleaned)")


def extraction_input(spark, sf):
    c = cleaned(spark, sf)
    detail = F.concat_ws(
        " | ", clean.combined_text(c),
        F.when(F.col("`Product Specification`") != NOT_AVAILABLE, F.col("`Product Specification`")),
        F.when(F.col("`Technical Details`") != NOT_AVAILABLE, F.col("`Technical Details`")),
        F.when(F.col("`Shipping Weight`") != NOT_AVAILABLE,
               F.concat(F.lit("Shipping Weight: "), F.col("`Shipping Weight`"))),
        F.when(F.col("`Product Dimensions`") != NOT_AVAILABLE,
               F.concat(F.lit("Product Dimensions: "), F.col("`Product Dimensions`"))),
        F.concat(F.lit("Brand: "), F.split_part(F.col("`Product Name`"), F.lit(" "), F.lit(1))))
    return c.select("product_id", F.col("Category").alias("category"),
                    F.expr(_question_sql("product_id", "`Product Name`")).alias("question"),
                    detail.alias("text"))


# -- SQL renderings of the pattern functions ----------------------------------

def sql_search(text: str, regex: str) -> str:
    return sql_strip(f"regexp_extract_all({text}, '(?i){regex}', 1)[1]")


def sql_kw_hit(ql: str, keywords) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(ql, k.replace("'", "''")) for k in keywords) + ")"


P = list(X.DEFAULT_TABLE.patterns)


def sql_extract_field(text: str, query: str) -> str:
    parts = [f"CASE WHEN {sql_kw_hit(f'lower({query})', p.keywords)} THEN {sql_search(text, p.regex)} END"
             for _, p in X.DEFAULT_TABLE.by_priority()]
    return "coalesce(" + ", ".join(parts) + ")"


_QW = f"list_distinct(list_filter(string_split_regex(lower(question), '{SPACE}+'), lambda w: w <> ''))"


def _fuzzy_cands() -> str:
    rows = []
    for i, p in enumerate(P):
        kw = "[" + ", ".join(f"'{k}'" for k in dict.fromkeys(p.keywords)) + "]"
        sim = f"len(list_intersect({_QW}, {kw})) / len(list_distinct(list_concat({_QW}, {kw})))"
        rows.append(f"SELECT product_id, {i} AS ord, {sim} AS sim, {sql_search('text', p.regex)} AS val FROM x")
    return " UNION ALL ".join(rows)


FUZZY_CTE = (f"{INPUT_CTE},\ncand AS ({_fuzzy_cands()}),\n"
             f"best AS (SELECT product_id, arg_max(val, sim * 1000 - ord) AS val, max(sim) AS sim FROM cand "
             f"WHERE sim >= {FUZZY_THRESHOLD} AND val IS NOT NULL GROUP BY product_id),\n"
             "fz AS (SELECT x.product_id, CASE WHEN b.val <> '' THEN b.val END AS value, "
             "CASE WHEN b.val <> '' THEN b.sim END AS confidence FROM x LEFT JOIN best b USING (product_id))")


# -- F14 -----------------------------------------------------------------------

@register("extract_all",
          f"WITH {INPUT_CTE} " + " UNION ALL ".join(
              f"SELECT product_id, '{p.field_name}' AS field, v AS value FROM "
              f"(SELECT product_id, {sql_search('text', p.regex)} AS v FROM x) WHERE v IS NOT NULL" for p in P))
def q_extract_all(spark, sf):
    return X.extracted_long(extraction_input(spark, sf), "product_id", "text")


# -- F13 -----------------------------------------------------------------------

@register("extract_by_query",
          f"WITH {INPUT_CTE} SELECT product_id, question, {sql_extract_field('text', 'question')} AS value FROM x")
def q_extract_by_query(spark, sf):
    x = extraction_input(spark, sf)
    return x.select("product_id", "question", X.extract_field("text", "question").alias("value"))


# -- F15 -----------------------------------------------------------------------

@register("field_query",
          f"WITH {INPUT_CTE} SELECT product_id, question, "
          f"{sql_kw_hit('lower(question)', FIELD_QUERY_INDICATORS)} AS is_field_query FROM x")
def q_field_query(spark, sf):
    x = extraction_input(spark, sf)
    return x.select("product_id", "question", X.is_field_query("question").alias("is_field_query"))


# -- F18 -----------------------------------------------------------------------

@register("fuzzy_extract",
          f"WITH {FUZZY_CTE} SELECT product_id, value, round(confidence, 6) AS confidence FROM fz")
def q_fuzzy(spark, sf):
    x = extraction_input(spark, sf)
    f = X.fuzzy_extract_field("text", "question")
    return x.select("product_id", f["value"].alias("value"), F.round(f["confidence"], 6).alias("confidence"))


# -- F19, F20 --------------------------------------------------------------------

_INFER = ("'$' || coalesce(regexp_extract_all(text, '(?i)\\$([0-9]+(?:\\.[0-9]+)?)', 1)[1], "
          "regexp_extract_all(text, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*(?:dollars?|usd)', 1)[1])")


@register("context_extract",
          f"WITH {FUZZY_CTE}, ex AS (SELECT product_id, {sql_extract_field('text', 'question')} AS exact FROM x) "
          "SELECT x.product_id, CASE WHEN ex.exact IS NOT NULL AND ex.exact <> '' THEN ex.exact "
          "WHEN fz.value IS NOT NULL AND fz.confidence >= 0.8 THEN fz.value "
          f"WHEN x.category IS NOT NULL AND x.category <> '' AND contains(lower(x.question), 'price') THEN {_INFER} "
          "END AS value FROM x JOIN ex USING (product_id) JOIN fz USING (product_id)")
def q_context(spark, sf):
    x = extraction_input(spark, sf)
    return x.select("product_id", X.context_aware_extract("text", "question", "category").alias("value"))


# -- F16 -----------------------------------------------------------------------

def _sugg_sql() -> str:
    first = {}
    for p in P:
        first.setdefault(p.field_name, p)
    rows = []
    for p in P:
        q = first[p.field_name]
        kw = "[" + ", ".join(f"'{k}'" for k in q.keywords[:3]) + "]"
        rows.append(f"SELECT product_id, '{p.field_name}' AS field, '{q.description}' AS description, v AS value, "
                    f"{kw} AS keywords FROM (SELECT product_id, {sql_search('text', p.regex)} AS v FROM x) "
                    f"WHERE v IS NOT NULL")
    return " UNION ALL ".join(rows)


@register("suggestions", f"WITH {INPUT_CTE} {_sugg_sql()}")
def q_suggestions(spark, sf):
    return X.field_suggestions(extraction_input(spark, sf), "product_id", "text") \
        .select("product_id", "field", "description", "value", "keywords")


# -- A4 ------------------------------------------------------------------------

_ANY = " OR ".join(f"{sql_search('text', p.regex)} IS NOT NULL" for p in P)


@register("extraction_stats",
          f"WITH {INPUT_CTE} SELECT count(*) AS total_texts, "
          f"CAST(sum(CASE WHEN {_ANY} THEN 1 ELSE 0 END) AS BIGINT) AS successful_extractions, "
          f"round(sum(CASE WHEN {_ANY} THEN 1 ELSE 0 END) / count(*), 6) AS extraction_rate FROM x")
def q_extraction_stats(spark, sf):
    totals, _, _ = X.extraction_report(extraction_input(spark, sf), "product_id", "text")
    return totals.select("total_texts", "successful_extractions", F.round("extraction_rate", 6).alias("extraction_rate"))


@register("extraction_field_counts",
          f"WITH {INPUT_CTE} " + " UNION ALL ".join(
              f"SELECT '{p.field_name}' AS field, count(*) AS n FROM x "
              f"WHERE {sql_search('text', p.regex)} IS NOT NULL HAVING count(*) > 0" for p in P))
def q_extraction_counts(spark, sf):
    _, counts, _ = X.extraction_report(extraction_input(spark, sf), "product_id", "text")
    return counts


@register("extraction_samples",
          f"WITH {INPUT_CTE} SELECT product_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' "
          "ELSE text END AS text_preview, array_to_string(list_sort(list_filter(["
          + ", ".join(f"'{p.field_name}=' || {sql_search('text', p.regex)}" for p in P)
          + "], lambda f: f IS NOT NULL)), '; ') AS fields FROM x ORDER BY product_id LIMIT 5")
def q_extraction_samples(spark, sf):
    _, _, samples = X.extraction_report(extraction_input(spark, sf), "product_id", "text")
    shown = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return samples.select("product_id", "text_preview", F.array_join(shown, "; ").alias("fields"))


# -- F17, P3: a caller's pattern --------------------------------------------------

_CUSTOM = r"(?:Size|Weight):\s*([^|]+)"


@register("extract_custom",
          f"WITH {INPUT_CTE} SELECT product_id, {sql_search('text', _CUSTOM)} AS measure FROM x")
def q_extract_custom(spark, sf):
    table = X.PatternTable([]).add_custom_pattern(["measure"], _CUSTOM, "measure", "Size or weight", priority=1)
    fields = X.extract_all_fields("text", table)
    return extraction_input(spark, sf).select("product_id", fields["measure"].alias("measure"))


# -- many patterns as data ---------------------------------------------------------

# A caller's glossary: for every distinct word of 6 letters or more in the benchmark's
# items, one pattern for the word that follows it and one for the rest of its own word.
GLOSSARY_SQL = r"""
words AS (SELECT w, min(item_id * 1000000 + pos) AS first FROM (
    SELECT item_id, unnest(l) AS w, unnest(range(len(l))) AS pos
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS l FROM benchmark))
  WHERE length(w) >= 6 GROUP BY w),
patterns AS (
  SELECT first * 2 AS ord, 'next_' || substr(w, 1, 3) AS field, w || '[^A-Za-z]+([A-Za-z]+)' AS regex, length(w) % 3 AS priority, w FROM words
  UNION ALL SELECT first * 2 + 1, 'rest_' || substr(w, 1, 3), w || '([A-Za-z]+)', 2 - length(w) % 3, w FROM words),
found AS (SELECT doc_id, field, ord, priority, regexp_extract(text, '(?i)' || regex, 1) AS value
  FROM documents JOIN patterns ON contains(lower(text), w) WHERE regexp_matches(text, '(?i)' || regex))"""


def glossary(spark, sf):
    words = (read_table(spark, sf, "benchmark", ["item_id", "text"])
             .select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("pos", "w"))
             .where(F.length("w") >= 6).groupBy("w").agg(F.min(F.col("item_id") * 1000000 + F.col("pos")).alias("first")))
    third = F.length("w") % 3

    def pattern(kind, n, tail, priority):
        return F.struct((F.col("first") * 2 + n).alias("ord"), F.concat(F.lit(f"{kind}_"), F.substring("w", 1, 3)).alias("field_name"),
                        F.concat("w", F.lit(tail)).alias("regex"), priority.alias("priority"), F.array("w").alias("keywords"))
    return words.select(F.inline(F.array(pattern("next", 0, "[^A-Za-z]+([A-Za-z]+)", third), pattern("rest", 1, "([A-Za-z]+)", 2 - third))))


@register("extract_many",
          f"WITH {GLOSSARY_SQL}, last AS (SELECT doc_id, field, arg_max(value, ord) AS value FROM found GROUP BY doc_id, field), "
          "done AS (SELECT doc_id, count(*) AS n, md5(string_agg(field || '=' || value, ';' ORDER BY field)) AS digest FROM last GROUP BY doc_id) "
          "SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_fields, coalesce(digest, md5('')) AS fields_md5 "
          "FROM documents LEFT JOIN done USING (doc_id)")
def q_extract_many(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    found = MP.extract_fields(docs, "text", "text", glossary(spark, sf)).select(
        "doc_id", F.array_sort(F.map_entries("fields")).alias("fields"))
    shown = F.array_join(F.transform("fields", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("doc_id", F.size("fields").cast("long").alias("n_fields"), F.md5(shown).alias("fields_md5"))


@register("extract_many_by_query",
          f"WITH {GLOSSARY_SQL}, done AS (SELECT doc_id, arg_min(value, struct_pack(p := priority, o := ord)) AS value FROM found GROUP BY doc_id) "
          "SELECT doc_id, value FROM documents LEFT JOIN done USING (doc_id)")
def q_extract_many_by_query(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return MP.extract_field(docs, "text", "text", glossary(spark, sf)).select("doc_id", "value")


@register("fuzzy_extract_many", ORACLES["fuzzy_extract"])
def q_fuzzy_many(spark, sf):
    found = MP.fuzzy_extract_field(extraction_input(spark, sf), "text", "question", X.DEFAULT_TABLE.to_df(spark))
    return found.select("product_id", F.col("fuzzy.value").alias("value"), F.round("fuzzy.confidence", 6).alias("confidence"))
