import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators.catalogue import search_catalogue
from shelfwise.operators.gram_index import build_gram_index, candidates, search_gram_index
from shelfwise.sources.io import shared_folder

SCHEMA = "product_id long, name string, price double, category string, description string, url string"


def catalogue(seed=1, n=200):
    r = random.Random(seed)
    word = lambda k: "".join(r.choices("aabBcé-", k=k))
    rows = [(i, r.choice([None, "", word(2), word(6), word(12), "Headphones " + word(2)]), r.choice([None, 20.0, 70.0, 300.0]),
             r.choice(["Toys", "hot category", None, word(3)]), r.choice([None, "", word(20)]), f"u{i}") for i in range(n)]
    return rows + [(7, "aaaaaaa", 5.0, "Toys", "aaab", "u7")]


QUERIES = ["a", "B", "ab", "é", "aab", "aaaa", "aaaaa", "bab-", "hot", "hot category", "category gift under $50", "under $100",
           "headphones", "toys", "", "zz", "zzz", "aabéa", "x\0", "\0", "-", None]


def expected(rows, query, k):
    if query is None:
        return []
    q = query.lower()
    names = {}
    for pid, name, price, category, description, _ in rows:
        texts = [t.lower() for t in (name, category, description) if t is not None]
        rule = ("under $100" in q and price is not None and price < 100
                or "under $100" not in q and "under $50" in q and price is not None and price < 50
                or "headphones" in q and "headphones" in (name or "").lower() or "toys" in q and "toys" in (category or "").lower()
                or q == "")
        if rule or any(q in t for t in texts if q):
            names[name] = min(names.get(name, pid), pid)
    return sorted((p, n) for n, p in names.items())[:k] if names else []


def rows_of(result):
    out = {}
    for r in result.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.product_id))
    return {q: sorted(set(v)) for q, v in out.items()}


@pytest.fixture(scope="module")
def built(spark):
    rows = catalogue()
    p = spark.createDataFrame(rows, SCHEMA)
    return rows, p, build_gram_index(p, shared_folder(spark, "gram-test"), buckets=6)


def asked(spark, queries=QUERIES):
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id long, query string")


def test_equals_brute_force_and_the_search_without_an_index(spark, built):
    rows, p, folder = built
    got = rows_of(search_gram_index(spark, folder, asked(spark)))
    want = {i: [(n + 1, pid) for n, (pid, _) in enumerate(expected(rows, q, 5))] for i, q in enumerate(QUERIES)}
    assert got == {i: v for i, v in want.items() if v}
    assert got == rows_of(search_catalogue(p, asked(spark)))


def test_fewer_results_and_no_more_than_the_index_keeps(spark, built):
    rows, _, folder = built
    got = rows_of(search_gram_index(spark, folder, asked(spark), max_results=2))
    assert got[0] == [(n + 1, pid) for n, (pid, _) in enumerate(expected(rows, "a", 2))]
    with pytest.raises(ValueError, match="keeps 5 names"):
        search_gram_index(spark, folder, asked(spark), max_results=6)


def test_probes_at_one_start_leave_few_candidates_to_verify(spark, built):
    rows, _, folder = built
    texts = {t.lower() for r in rows for t in (r[1], r[3], r[4]) if t}
    ql = spark.createDataFrame([("aaaaa",), ("aab",), ("hot cat",)], "ql string")
    got = {(r.ql, r.text) for r in candidates(spark, folder, ql).join(spark.read.parquet(f"{folder}/texts"), "text_id").collect()}
    assert got == {(q, t) for q in ("aaaaa", "aab", "hot cat") for t in texts if q in t}  # three probes cover five characters


def test_the_index_side_is_not_shuffled(spark, built):
    _, _, folder = built
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = candidates(spark, folder, asked(spark).select(F.lower("query").alias("ql")).distinct())
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "gram_index_" in line and "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above), text


def test_another_session_opens_the_index(spark, built):
    rows, _, folder = built
    other = spark.newSession()
    name = next(t.name for t in other.catalog.listTables() if t.name.startswith("gram_index_"))
    assert name
    spark.sql(f"DROP TABLE {name}")          # external: the files stay
    got = rows_of(search_gram_index(other, folder, other.createDataFrame([(1, "hot")], "query_id long, query string")))
    assert got[1] == [(n + 1, pid) for n, (pid, _) in enumerate(expected(rows, "hot", 5))]


def test_empty_catalogue_and_no_queries(spark, built):
    empty = build_gram_index(spark.createDataFrame([], SCHEMA), shared_folder(spark, "gram-test"), buckets=3)
    assert search_gram_index(spark, empty, asked(spark)).count() == 0
    assert search_gram_index(spark, built[2], asked(spark, [None])).count() == 0
