"""Many patterns as data: the same values as one by one, odd cases, a plan of one size."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import extract as X
from shelfwise.operators import many_patterns as MP

TEXT = "id int, text string, query string"
PATTERNS = "ord long, field_name string, regex string, priority int, keywords array<string>"


def _rows(seed, n, words):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 14)))
    return [(i, line(), line()) for i in range(n)]


@pytest.mark.parametrize("part_bytes", [MP.PART_BYTES, 600])
def test_equal_to_one_by_one(spark, part_bytes):
    words = ["Price:", "$12.50", "9 usd", "price", "Size:", "3 x 4 in", "size", "Brand:", "|", "brand", "made of", "Color:", "color",
             "weight", "Weight:", "Item", "2 lbs", "model", "Model:", "X-1", "WIDTH", " ", "é"]
    table = X.PatternTable([*X.DEFAULT_PATTERNS,
                            X.FieldPattern("price", r"([0-9]+) usd", 1, "again", ("usd", "price")),
                            X.FieldPattern("blank", r"\|(\s*)", 1, "may be blank", ("|", "brand"))])
    df = spark.createDataFrame(_rows(1, 400, words), TEXT)
    patterns = table.to_df(spark)
    one = df.select("id", X.extract_field("text", "query", table).alias("value"),
                    X.fuzzy_extract_field("text", "query", 0.1, table).alias("fuzzy")).collect()
    many = MP.extract_field(df, "text", "query", patterns, part_bytes=part_bytes)
    many = MP.fuzzy_extract_field(many, "text", "query", patterns, 0.1, part_bytes=part_bytes).select("id", "value", "fuzzy").collect()
    assert sorted(many) == sorted(one)
    assert sum(r["value"] is not None for r in one) > 50 and sum(r["fuzzy"] is not None for r in one) > 20

    fields = {r["id"]: r["fields"] for r in MP.extract_fields(df, "text", "query", patterns, part_bytes=part_bytes).collect()}
    # every pattern by itself, the last of a field that matches
    singly = df.select("id", *[F.when(X._keyword_hit(F.lower("query"), p.keywords), X.search_group1("text", p.regex)).alias(f"p{i}")
                               for i, p in enumerate(table.patterns)]).collect()
    for r in singly:
        want = {p.field_name: r[f"p{i}"] for i, p in enumerate(table.patterns) if r[f"p{i}"] is not None}
        assert fields[r["id"]] == want


def test_thousands_of_patterns_by_brute_force(spark):
    r = random.Random(3)
    names = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(12000)})
    rows = [(i, f"f{i % 700}", rf"{n} ([a-h]+)", i % 4, [n]) for i, n in enumerate(names)]
    assert len(rows) > 5000
    texts = [(i, t, t) for i, t, _ in _rows(4, 60, names)]
    patterns, df = spark.createDataFrame(rows, PATTERNS), spark.createDataFrame(texts, TEXT)
    MP.check_patterns(patterns)
    found = {x["id"]: (x["value"], x["fields"]) for x in MP.extract_fields(
        MP.extract_field(df, "text", "query", patterns), "text", "query", patterns).collect()}
    for i, text, query in texts:
        hits = [(priority, ord_, field, m.group(1)) for ord_, field, regex, priority, (k,) in rows
                if k in query and (m := re.search(regex, text))]
        fields = {field: value for _, _, field, value in sorted(hits, key=lambda h: h[1])}
        assert found[i] == (min(hits)[3] if hits else None, fields)


def test_plan_does_not_grow_with_the_patterns(spark):
    df = spark.createDataFrame([(1, "a", "b")], TEXT)

    def size(n):
        patterns = spark.createDataFrame([(i, f"f{i}", f"w{i} (x)", 1, [f"w{i}"]) for i in range(n)], PATTERNS)
        plan = MP.extract_fields(df, "text", "query", patterns)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        return len(re.sub(r"c[0-9a-f]{32}|#\d+", "", plan))
    assert abs(size(5000) - size(10)) < 50


def test_odd_cases(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "k 1", None), (3, "", ""), (4, "k 1", "K"), (4, "k 1", "K"),
                                (5, "k 7 " * 50_000 + "z 9", "z")], TEXT).withColumn("ord", F.lit(7)).withColumn("field", F.lit("own"))
    patterns = spark.createDataFrame([(1, "a", r"k ([0-9])", 1, ["k"]), (2, "b", r"(.*)", 2, [""]), (3, "c", r"(.)", 0, None),
                                      (4, "d", r"(.)", 0, []), (5, "e", None, 0, ["k", None]), (6, "z", r"z ([0-9])", 0, ["z", "z"])], PATTERNS)
    rows = MP.extract_fields(MP.extract_field(df, "text", "query", patterns), "text", "query", patterns).orderBy("id").collect()
    assert [(r["id"], r["value"]) for r in rows] == [(1, None), (2, None), (3, ""), (4, "1"), (4, "1"), (5, "9")]
    assert rows[0]["fields"] == {} and rows[1]["fields"] == {} and rows[2]["fields"] == {"b": ""}
    assert rows[3]["fields"] == {"a": "1", "b": "k 1"} and rows[5]["fields"]["z"] == "9"
    assert all(r["ord"] == 7 and r["field"] == "own" for r in rows)
    for f in (MP.extract_field, MP.extract_fields, MP.fuzzy_extract_field):
        none = f(df, "text", "query", patterns.limit(0), out="x").collect()
        assert len(none) == 6 and not any(r["x"] for r in none)
        assert f(df.limit(0), "text", "query", patterns, out="x").collect() == []
    with pytest.raises(ValueError, match="already"):
        MP.extract_field(df, "text", "query", patterns, out="text")
    with pytest.raises(ValueError, match="threshold"):
        MP.fuzzy_extract_field(df, "text", "query", patterns, 0.0)


def test_check_patterns(spark):
    make = lambda rows: spark.createDataFrame(rows, PATTERNS)
    MP.check_patterns(make([(1, "a", "(x)", 1, ["x"]), (2, "b", None, 1, None)]))
    for bad in ([(1, "a", "(x", 1, ["x"])], [(1, "a", "x", 1, ["x"])], [(1, "a", "(x)", 1, ["x"]), (1, "b", "(y)", 1, ["y"])],
                [(None, "a", "(x)", 1, ["x"])]):
        with pytest.raises(ValueError):
            MP.check_patterns(make(bad))


def test_plain_regexes_equal_a_search_of_the_whole_text(spark):
    r = random.Random(8)
    words = ["glass", "Glass", "GLAẞ", "glaſs", "İkea", "Kıt", "\u212aite", "kite", "kit", "kitE9", "glasses", "ßglass", "日本", "--", "\n", "9", ",", "é"]
    regexes = [r"glass([A-Za-z]+)", r"glass[^A-Za-z]+([A-Za-z]+)", r"kit([a-z0-9]*?)e", r"kite? ([^a-z]+)", r"ki([0-9])?t", r"gla[a-z]+,?( )",
               r"kit+([0-9])", r"(kit)", r"kit|(glass)", r"kit(?=e)(.)", r"glass()", r"kit(e|es)", r"kit\b(.)", r"glas{2}(.)", r"kit([0-9]) *", "ik([a-z])"]
    patterns = [(i, f"f{i}", x, i % 3, [re.match(r"\W*([a-z]+)", x)[1][:2]]) for i, x in enumerate(regexes)]
    texts = ["".join(r.choice(words) + r.choice(["", " ", "  "]) for _ in range(r.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(i, t, "glass kit ik") for i, t in enumerate(texts)], TEXT)
    got = {x["id"]: x["fields"] for x in MP.extract_fields(df, "text", "query", spark.createDataFrame(patterns, PATTERNS)).collect()}
    whole = df.select("id", *[X.search_group1("text", x).alias(f"f{i}") for i, x in enumerate(regexes)]).collect()
    assert got == {x["id"]: {k: v for k, v in x.asDict().items() if k != "id" and v is not None} for x in whole}
    assert sum(any(x[f"f{i}"] is not None for x in whole) for i in range(len(regexes))) > 11


def test_characters_equal_to_ascii_ones_are_those_known(spark):
    codes = spark.range(128, 0x110000).where("id < 55296 OR id > 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    like = codes.select("id", char.alias("c")).where(F.regexp_like("c", F.lit("(?iu)[a-z0-9 _.,:;]")))
    assert {chr(x["id"]) for x in like.collect()} == {c for c in map(chr, range(128, 0x110000)) if MP._FOLDED.match(c)}


def test_plain_regexes_are_not_searched_in_the_whole_text(spark):
    text = " ".join(f"wordword{i:04d} " + "abcd " * 60 for i in range(400))
    patterns = spark.createDataFrame([(i, f"f{i}", f"wordword{i:04d}([a-z]+)", 1, [f"wordword{i:04d}"]) for i in range(400)], PATTERNS)
    places = MP._Places([(x["ord"], x["field_name"], x["regex"], tuple(x["keywords"])) for x in patterns.collect()])
    assert places(text, list(range(400)), None) == ([], None, [])
    assert places(text + " wordword0007xY z", [6, 7], [0.5, 0.25]) == ([7], [0.25], ["wordword0007xY"])
