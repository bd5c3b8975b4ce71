import datetime as dt
import random

from shelfwise.llm import url_lists as U

CAPS = "page_id bigint, url string, fetch_day date, host string, kind string, bucket int, salt int"
ENTRIES = "kind string, pattern string, category string, action string, effective date, removed boolean, until date"
D0 = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else D0 + dt.timedelta(n)


def world():
    r = random.Random(8)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.example.org", "other.net", "localhost"]
    entries = [(k, p, r.choice(["spam", "adult"]), r.choice(["add", "remove", "add", "noise"]), day(r.randint(0, 200)), True, None)
               for k, p in [("domain", h) for h in [*hosts, "example.org", "com"]] + [("url", "a.example.com/p"), ("url", "other.net/")]
               for _ in range(12)]
    entries += [("domain", None, "spam", "add", D0, True, None), ("domain", "other.net", "spam", "add", None, True, None),
                (None, "other.net", "spam", "add", D0, True, None), ("domain", "other.net", None, "add", day(50), True, None)]
    urls = [f"{s}://{u}{h}{p}" for h in hosts for s in ("http", "HTTPS") for u in ("", "me:pw@") for p in ("", "/", "/p", "/p?x=1#f", ":80/p")]
    urls += [None, "", "no url", "http://", "http:///p", "HTTP://A.EXAMPLE.COM./p"]
    caps = [(i, u, day(r.randint(0, 230)), "h", "k", 1, 2) for i, u in enumerate(urls * 3)]
    caps += [(None, "http://a.example.com/p", day(100), "h", "k", 1, 2), (5, "http://other.net/", None, "h", "k", 1, 2)] + caps[:4]
    return caps, entries


def host_path(url):
    import re
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return None, None
    h = re.match(r"^(?:.*@)?([^:@]*?)\.?(?::[0-9]*)?$", m[1])
    host = h[1].lower() if h else ""
    return (host, host + m[2]) if host else (None, None)


def brute(caps, entries):
    state = {}
    for kind, pattern, category, action, at, *_ in entries:
        if pattern is not None and at is not None and action in ("add", "remove"):
            days = state.setdefault((kind, pattern, category), {})
            days[at] = "remove" if "remove" in (days.get(at), action) else "add"
    out = {}
    for page, url, at, *_ in caps:
        host, key = host_path(url)
        hits = []
        if host and at:
            names = [("url", key)] + [("domain", ".".join(host.split(".")[i:])) for i in range(len(host.split(".")))]
            for (kind, pattern, category), days in state.items():
                past = [d for d in days if d <= at]
                if (kind, pattern) in names and past and days[max(past)] == "add":
                    hits.append((kind != "url", -len(pattern), pattern, category is not None, category, kind))
        best = min(hits, default=None)
        n = out.get((page, url, at), (0, 0, 0, 0, 0))[-1]
        out[page, url, at] = (host, best[2] if best else None, best[4] if best else None, len(hits), n + 1)
    return out


def test_captures_are_judged_as_of_their_day(spark):
    caps, entries = world()
    got = U.filter_captures(spark.createDataFrame(caps, CAPS), spark.createDataFrame(entries, ENTRIES), salts=3).collect()
    want = brute(caps, entries)
    assert len(got) == len(want)
    for r in got:
        assert (r.host, r.pattern, r.category, r.n_active, r.captures) == want[r.page_id, r.url, r.fetch_day], r
        assert r.blocked == (r.n_active > 0)
    assert sum(r.blocked for r in got) > 50


def test_empty_tables_and_native_plan(spark):
    caps, entries = world()
    none = spark.createDataFrame([], ENTRIES)
    assert not any(r.blocked for r in U.filter_captures(spark.createDataFrame(caps, CAPS), none).collect())
    assert U.filter_captures(spark.createDataFrame([], CAPS), spark.createDataFrame(entries, ENTRIES)).collect() == []
    plan = U.filter_captures(spark.createDataFrame(caps, CAPS), none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
