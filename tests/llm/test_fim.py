import hashlib
import re

import pytest
from llm_rows import make_docs, odd_rows, prose  # noqa: F401

from shelfwise.llm import fim

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
TEXTS = ["", "a", "é", "ab cd", "日本 語\nx", "<P>", "a<S>b", "x<M", "<<S", "<P<P", "end<", "🏳️‍🌈👩‍👩‍👧", "a" * 5000, " " * 5000,
         prose(4000, 7), "Ünï cödé " * 900, "<S<M<P " * 400, "\x00\x7f" * 300]


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "psm"
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form = "plain"
    elif h4 % 100 < 20:
        form = "spm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    lengths = (None, None) if form == "plain" else (len(prefix), len(middle))
    return doc_id, n, form, *lengths, out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("frame_bytes", [1, 7, 100, fim.FRAME_BYTES])
def test_equals_plain_cuts(make_docs, frame_bytes):
    rows = [(i, TEXTS[i % len(TEXTS)], "en", "s", 1) for i in range(4 * len(TEXTS))]
    rows = rows[:18] if frame_bytes == 1 else rows + odd_rows()
    frames = fim.to_frames(make_docs(rows, clashing=True), frame_bytes)
    want = [(*plain(r[0], r[1]), r[1] or "") for r in rows]
    got = fim.digests(frames).drop("frames", "frames_opened").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=repr)
    assert sorted(map(tuple, fim.outputs(frames).collect()), key=repr) == sorted(((w[0], w[2], w[5]) for w in want), key=repr)
    if frame_bytes == 100:
        assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_frames_end_at_units_and_cuts_open_two_at_most(make_docs):
    text = prose(4000, 7)
    stored = fim.compress(text.encode(), 500)
    parts = [fim.Reader(stored).opener.decompress(f).decode() for f in stored.frames]
    assert "".join(parts) == text and len(parts) > 30
    assert [sum(len(UNITS.findall(p)) for p in parts[:i + 1]) for i in range(len(parts))] == stored.units
    assert [len("".join(parts[:i + 1])) for i in range(len(parts))] == stored.chars
    assert max(map(len, parts)) <= 500
    rows = fim.digests(fim.to_frames(make_docs([(i, text, "en", "s", 1) for i in range(30)]), 500)).collect()
    assert all(r["frames_opened"] <= 2 < r["frames"] for r in rows)


def test_every_cut_of_a_reader():
    for text in TEXTS:
        units = UNITS.findall(text)
        for size in (3, 64):
            reader = fim.Reader(fim.compress(text.encode(), size))
            for k in {0, 1, 2, len(units) // 2, len(units)} & set(range(len(units) + 1)):
                head = b"".join(reader.section((0, 0, 0), reader.cut(k))).decode()
                assert head == "".join(units[:k]) and reader.cut(k)[2] == len(head)


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_marks_across_parts_are_read_back(form):
    parts = {b"<P>": b"a<S<", b"<S>": b"<M", b"<M>": b""}
    whole = b"".join(m + parts[m] for m in fim.ORDER[form])
    for step in (1, 2, 3, 5, 100):
        stream = (whole[i:i + step] for i in range(0, len(whole), step))
        assert b"".join(fim.restored(stream, form)) == b"a<S<" + b"" + b"<M"
    with pytest.raises(ValueError):
        list(fim.restored(iter([b"no marks"]), form))


def test_empty_table(make_docs):
    assert fim.fim_digest(make_docs([])).count() == 0
