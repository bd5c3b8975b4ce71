import hashlib

from llm_rows import prose
from pyspark.sql import functions as F

from shelfwise.llm import warc
from shelfwise.llm.common import open_file, scratch

SCHEMA = "page_id bigint, url string, html string, digest string, offset bigint, first bigint, payload string"


def rows():
    big = prose(40, 1)
    out = [(i, f"http://h/{i}", f"<p>{prose(20, i)}</p>") for i in range(50)]
    out += [(100 + i, f"http://copy/{i}", big) for i in range(60)] + [(99, "http://first/", big), (99, "http://first/again", big)]
    out += [(200, None, "short"), (201, "http://x/\r\nWARC-Type: evil", "short"), (202, "http://é/ü?q=a b", None), (203, "", ""),
            (None, "http://null/", big), (None, None, None), (300, "u", "x" * 99), (301, "u", "x" * 99), (302, "u", "é" * 50), (303, "u", "é" * 50),
            (304, "u", "y" * 500_000), (305, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "only null", prose(50, 7)), (None, "only null", prose(50, 7))]
    return out


def brute(all_rows):
    groups = {}
    for i, _, html in all_rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            groups[data] = min(groups.get(data, i), i)
    out = []
    for i, _, html in all_rows:
        data = (html or "").encode()
        first = groups.get(data, i)
        revisit = first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def full(spark, some):
    return spark.createDataFrame([(*r, "d", 1, 2, "p") for r in some], SCHEMA)


def key(r):
    return tuple((x is None, x) for x in r)


def test_round_trip(spark):
    got = [tuple(r) for r in warc.warc_digest(full(spark, rows())).collect()]
    assert sorted(got, key=key) == sorted(brute(rows()), key=key)


def test_selected_records_and_payloads(spark, monkeypatch):
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(full(spark, rows()), folder)
    some = index.filter("page_id in (3, 17, 304, 305, 202) or url = 'http://copy/5'")
    got = {r.page_id: r for r in warc.read_records(some, folder).collect()}
    want = {i: h for i, _, h in rows()}
    assert set(got) == {3, 17, 304, 305, 202, 105}
    for i in (3, 17, 304, 305, 202):
        assert bytes(got[i].payload).decode() == (want[i] or "")
    assert got[105].payload is None and got[105].refers_to == 99
    assert {r.url for r in index.select("url").collect()} == {u for _, u, _ in rows()}
    row = index.filter("page_id = 201").collect()[0]
    with open_file(folder, row.file) as f:
        record = warc.zlib.decompress(f.read_at(row.length, row.offset), 31)
    assert record.count(b"WARC-Type:") == 1 + record.count(b"%0D%0AWARC-Type:") == 2
    assert index.filter(F.col("length") <= 0).count() == 0


def test_neighbours_share_a_read():
    at = lambda f, o, n: {"file": f, "offset": o, "length": n}
    rows_ = [at("a", 0, 10), at("a", 10, 10), at("a", 30 + warc.GAP, 5), at("a", 35 + warc.GAP, warc.READ_BYTES), at("b", 0, 1)]
    assert [len(r) for r in warc._ranges(rows_)] == [2, 1, 1, 1]
    assert list(warc._ranges([])) == []


def test_archives_begin_anew_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    index = warc.write_archives(full(spark, rows()[:9]).coalesce(1), scratch(spark, "warc-test"))
    assert index.select("file").distinct().count() == 9
    assert warc.warc_digest(full(spark, [])).collect() == []


def test_a_small_bit_table_misjudges_but_loses_nothing(spark, monkeypatch):
    for slots in (64, 256):  # all bits set, and some
        monkeypatch.setattr(warc, "SLOTS", slots)
        got = [tuple(r) for r in warc.warc_digest(full(spark, rows())).collect()]
        assert sorted(got, key=key) == sorted(brute(rows()), key=key)
