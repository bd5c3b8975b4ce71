import random
import re

from llm_rows import make_docs, odd_rows, prose  # noqa: F401
from pyspark.sql import functions as F

from shelfwise.llm import licenses as L


def plain(text):
    """Every block against every template, and every place of every phrase."""
    words = L.template_words(text or "")
    base = [(i, label) for phrase, label in L.PHRASES for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    found, share, n = set(), 0.0, 0
    for label, template in L.TEMPLATES:
        t = set(L.template_words(template))
        w = L.width(len(L.template_words(template)))
        for a in range(max(-(-len(words) // w) - 2, 0) + 1):
            shared = len(t & set(words[a * w:(a + 2) * w]))
            if shared * 100 >= len(t) * L.THRESHOLD:
                found.add(label)
                share, n = max(share, shared / len(t)), n + 1
    at, labels = [i for i, _ in base], {x for _, x in base}
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | found)), 1.0 if base else share, n)


def changed(text, n, rng):
    """The text with n of its words replaced."""
    parts = text.split()
    for i in rng.sample(range(len(parts)), n):
        parts[i] = prose(1, rng.random())
    return " ".join(parts)


def texts():
    rng = random.Random(5)
    out = [L.TEMPLATES[0][1] * 3, "mit license mit license", "GNU  GENERAL\npublic-license", "cc BY", "a cc, by b", "acc by",
           "the of and is this by", "\x00MIT\x7fLicense", "ÀMIT License", "mit licenseé", " ".join(["license"] * 5000)]
    for _, template in L.TEMPLATES:
        for n in range(0, len(template.split()), max(1, len(template.split()) // 8)):
            out.append(f"{prose(rng.randint(0, 90), n)} {changed(template, n, rng)} {prose(rng.randint(0, 300), n + 1)}")
    words = [w for _, t in L.TEMPLATES for w in L.template_words(t)]
    out += [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(60)]
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                                       "n_blocks").collect()), key=repr)


def test_equals_brute_force(make_docs):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts())] + odd_rows()
    got = rows_of(L.license_digest(make_docs(rows, clashing=True)))
    want = sorted(((r[0], *plain(r[1])) for r in rows), key=repr)
    assert got == want
    assert sum(r[-1] > 0 for r in want) > 12 and sum(r[-1] == 0 for r in want) > 20


def test_other_templates_and_thresholds(make_docs, monkeypatch):
    own = (("x", "red green blue cyan"), ("y", "one two three four five six seven eight nine ten " * 3 + "eleven"))
    rows = [(1, "Green, red; blue! and more", "en", "s", 1), (2, "ten nine eight seven six five four three two one", "en", "s", 1),
            (3, "red green", "en", "s", 1)]
    monkeypatch.setattr(L, "TEMPLATES", own)
    for threshold in (50, 75, 100):
        monkeypatch.setattr(L, "THRESHOLD", threshold)
        got = rows_of(L.license_digest(make_docs(rows), own, threshold))
        assert got == sorted(((r[0], *plain(r[1])) for r in rows), key=repr)


def test_blocks_hold_any_run_and_pairs_are_found_once(make_docs):
    template = L.TEMPLATES[2][1]
    text = " ".join([prose(37, 1), template, prose(211, 2), template, prose(5, 3)])
    _, met = L.scan(make_docs([(1, text, "en", "s", 1)]))
    pairs = met.select("key", "width", "block", "template").collect()
    assert len(pairs) == len(set(pairs)) and met.select("label").distinct().collect() == [("gpl-3.0",)]
    places = {r["block"] for r in pairs}
    for start in (37, 37 + 12 + 211):
        assert any(b * 16 <= start and start + 12 <= (b + 2) * 16 for b in places)


def test_empty_table_and_native_plan(make_docs):
    assert L.license_digest(make_docs([])).count() == 0
    rows, met = L.scan(make_docs([(1, L.TEMPLATES[0][1], "en", "s", 1)]))
    for df in (rows, met, L._with_words(make_docs([]))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("ArrowEval|BatchEval|MapIn|FlatMapGroups|CartesianProduct|NestedLoop", plan)
    assert met.agg(F.count("label")).first()[0] == 1


def test_texts_are_cut_into_words_once(make_docs, monkeypatch):
    calls, cut = [], L._with_words
    monkeypatch.setattr(L, "_with_words", lambda docs: calls.append(1) or cut(docs))
    rows, met = L.scan(make_docs([(1, f"so {L.TEMPLATES[0][1]}", "en", "s", 1)]))
    assert rows.count() == met.count() == len(calls) == 1


def test_words_and_case_as_the_contract_has_them(make_docs):
    texts = ["", " ", "A", " A-B ", "É K İ ſ ÀMIT A", "MIT", "\x00a\x7fB\x80C", "a\U0001f642B c", "x" * 3 + "," * 9]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(len(texts), None, "en", "s", 1)]
    got = {r["doc_id"]: (r["low"], r["words"]) for r in L._with_words(make_docs(rows)).collect()}
    low = [(t or "").translate(str.maketrans(L._UPPER, L._LOWER)) for _, t, *_ in rows]
    assert got == {i: (t, re.findall(L.WORD, t)) for i, t in enumerate(low)}
