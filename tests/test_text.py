from pyspark.sql import functions as F

from shelfwise.functions.text import cut_at_first_stop, overlap, strip, token_set, whitespace_words, word_count
from shelfwise.operators.search import rerank_by_overlap


def test_token_set_matches_word_characters(spark):
    df = spark.createDataFrame([("Hello World! This is a test-123.",), ("Café naïve ÉTÉ_x",)], "t string")
    rows = df.select(F.array_sort(token_set("t")).alias("s")).collect()
    assert rows[0].s == sorted(["hello", "world", "this", "is", "a", "test", "123"])
    assert rows[1].s == sorted(["café", "naïve", "été_x"])


def test_overlap_counts_shared_distinct_tokens(spark):
    df = spark.createDataFrame([("wireless mouse gaming", "Gaming mouse, wired")], "a string, b string")
    assert df.select(overlap(token_set("a"), token_set("b")).alias("o")).first().o == 2


def test_rerank_orders_by_overlap_stable(spark):
    hits = spark.createDataFrame([
        (1, 1, 10, 0.1, "wireless mouse gaming", "Keyboard with lights"),
        (1, 2, 11, 0.2, "wireless mouse gaming", "Wireless gaming mouse"),
        (1, 3, 12, 0.3, "wireless mouse gaming", "Mouse pad"),
        (1, 4, 13, 0.4, "wireless mouse gaming", "Gaming chair"),
    ], "query_id int, rank int, vec_id int, score double, text_query string, combined_text string")
    out = rerank_by_overlap(hits).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [11, 12, 13, 10]
    assert all(r.score == 0.0 for r in out)
    assert [r.orig_rank for r in out] == [2, 3, 4, 1]


def test_word_count_and_stop_cut(spark):
    df = spark.createDataFrame([("  one two\tthree\nfour  ", "Answer text\nQ: next question\nUser question: x")],
                               "a string, b string")
    r = df.select(word_count("a").alias("n"),
                  cut_at_first_stop("b", ["\nUser question:", "\nQ:"]).alias("c")).first()
    assert r.n == 4
    # the first listed stop that occurs applies
    assert r.c == "Answer text\nQ: next question"


def test_unicode_white_space_is_stripped_and_splits(spark):
    text = "\u00a0\u2003 one\u00a0two\u3000three\x85four\x1cfive\x0bsix \u2028"
    df = spark.createDataFrame([(text,), (" \u00a0 ",), (None,)], "t string")
    rows = df.select(strip("t").alias("s"), whitespace_words("t").alias("w")).collect()
    assert rows[0].s == text.strip() and rows[0].w == text.split()
    assert rows[1].s == "" and rows[1].w == [] and rows[2].w == []
