"""URL filters, divergence audit and interval join, against plain versions and SQL."""

import collections
import math
import random
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import divergence, interval_join, url_filters


# ---- interval join

HOUR = 3_600_000_000


def pairs(sales, clicks, lines, gap=600_000_000):
    """(sale_id, relation) -> [pairs, shared slots or None, crc] of rows with microseconds."""
    by = collections.defaultdict(list)
    for us, client, kind in clicks:
        if us is not None and client is not None:
            by[client].append((us, kind))
    held = collections.defaultdict(list)
    for client, seen in by.items():
        seen.sort(key=lambda x: x[0])
        runs = [[seen[0]]]
        for x in seen[1:]:
            if x[0] - runs[-1][-1][0] > gap:
                runs.append([])
            runs[-1].append(x)
        for run in runs:
            open_ = any(us == run[-1][0] and kind == "purchase" for us, kind in run)
            held[client].append((run[0][0], run[0][0] // HOUR, math.inf if open_ else run[-1][0] // HOUR))
    names = interval_join.RELATIONS
    out = {}
    for sale, client, us in sales:
        if client is None or us is None:
            continue
        own = [s for i, s in lines if i == sale and i is not None]
        a = us // HOUR
        b = math.inf if None in own else max([us, *own]) // HOUR
        for first, c, d in held[client]:
            if a <= d and c <= b:
                name = names[0 if a < c else 1 if a == c else 2][0 if b < d else 1 if b == d else 2]
                x = out.setdefault((sale, name), [0, 0, 0])
                x[0] += 1
                x[1] = None if b == d == math.inf else x[1] + min(b, d) - max(a, c) + 1
                x[2] += zlib.crc32(str(first).encode())
    return {k: tuple(v) for k, v in out.items()}


def shop(spark, sales, clicks, lines):
    at = lambda us: None if us is None else datetime(1970, 1, 1) + timedelta(microseconds=us)
    s = spark.createDataFrame([(i, c, at(u), "x") for i, c, u in sales], "sale_id long, client_id long, sold_at timestamp_ntz, start string")
    k = spark.createDataFrame([(at(u), c, kind, "x") for u, c, kind in clicks], "ts timestamp_ntz, client_id long, kind string, bucket string")
    ls = spark.createDataFrame([(i, at(u), 1) for i, u in lines], "sale_id long, shipped_at timestamp_ntz, open int")
    return s, k, ls


def joined(spark, sales, clicks, lines):
    s, k, ls = shop(spark, sales, clicks, lines)
    found = interval_join.related(interval_join.slots(interval_join.sale_intervals(s, ls)), interval_join.slots(interval_join.sessions(k)), 100).collect()
    out = {(r.sale_id, r.relation): (r.n_pairs, r.overlap_slots, r.sessions_crc) for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_interval_join_is_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(interval_join, "LEAST", 5)  # so that clients are dealt to several shards
    monkeypatch.setattr(interval_join, "SHARES", 10)
    r = random.Random(seed)
    base = -3 * 86_400_000_000 if seed == 2 else 1_704_067_200_000_000
    time = lambda: base + r.randrange(6 * 86_400_000_000) // (1, 60_000_000, 1)[seed] * (1, 60_000_000, 1)[seed]
    clicks = [(time() if r.random() > 0.02 else None, r.choice([1, 1, 1, 2, 3, None]), r.choice(["view", "purchase", None, "click"])) for _ in range(900)]
    clicks += clicks[:50]
    sales = [(i, r.choice([1, 1, 2, 3, 4, None]), time() if r.random() > 0.05 else None) for i in range(120)]
    sales += [(None, 1, base), (7, 2, base + 5), (7, 2, base + 5), (200, 1, base - 10**13), (201, 1, base + 10**13), (202, 1, base - 10**13), (203, 1, base + 10**13)]
    lines = [(r.choice([*range(120), 300, None]), None if r.random() < 0.1 else time()) for _ in range(260)] + [(201, None), (202, base + 10**13), (200, None), (203, base)]
    assert joined(spark, sales, clicks, lines) == pairs(sales, clicks, lines)


def test_a_client_dealt_to_more_ways_than_shards_meets_each_session_once(spark, monkeypatch):
    monkeypatch.setattr(interval_join, "LEAST", 1)  # a way a sale, of which there are more than shards
    clicks = [(k * HOUR // 2, 1 + k % 2, "click") for k in range(60)]
    sales = [(i, 1 + i % 2, i * 60_000_000) for i in range(400)]
    lines = [(i, (i + i % 90) * 60_000_000) for i in range(400)]
    assert joined(spark, sales, clicks, lines) == pairs(sales, clicks, lines)


def test_nested_lists_of_any_depth_and_with_overlaps():
    r = np.random.default_rng(5)
    for case in range(60):
        n, clients, width = int(r.integers(1, 60)), int(r.integers(1, 4)), 40
        a = r.integers(0, width - 1, n)
        rows = sorted({(int(o), int(s), int(min(width - 1, s + d))) for o, s, d in zip(r.integers(0, clients, n), a, r.integers(0, 25 if case % 2 else 4, n))}, key=lambda _: r.random())
        o, s, e = (np.array(x, np.int64) for x in zip(*rows))
        w, crc = r.integers(1, 5, len(rows)), r.integers(0, 1 << 32, len(rows))
        lists = interval_join.nest(o, s, e, w, crc, width + 1, clients)
        q = int(r.integers(1, 30))
        of, qa = r.integers(0, clients, q), r.integers(0, width, q)
        qb = np.minimum(width - 1, qa + r.integers(0, 20, q))
        out = np.zeros((3, 9, q), np.int64)
        interval_join.search(lists, of, qa, qb, qa, qb, out)
        want = np.zeros_like(out)
        for i in range(q):
            for j in range(len(rows)):
                if o[j] == of[i] and s[j] <= qb[i] and qa[i] <= e[j]:
                    x = 3 * (0 if qa[i] < s[j] else 1 if qa[i] == s[j] else 2) + (0 if qb[i] < e[j] else 1 if qb[i] == e[j] else 2)
                    want[:, x, i] += (w[j], w[j] * (min(qb[i], e[j]) - max(qa[i], s[j]) + 1), crc[j])
        assert (out == want).all()


def test_interval_join_of_empty_tables_and_other_zones(spark):
    sales, clicks, lines = [(1, 1, 0)], [(10, 1, "view")], [(1, 5)]
    assert joined(spark, [], clicks, lines) == {} and joined(spark, sales, [], lines) == {}
    assert joined(spark, sales, clicks, []) == {(1, "equals"): (1, 1, zlib.crc32(b"10"))}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        us = 1_710_037_800_123_457  # half past two of a night whose clocks went forward there
        assert joined(spark, [(1, 1, us)], [(us, 1, "purchase")], []) == pairs([(1, 1, us)], [(us, 1, "purchase")], [])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# ---- divergence audit


def audited(rows, least, top=50):
    docs = [((t or ""), (lang or ""), (s or "")) for t, lang, s in rows]
    terms = lambda t: [bytes(x + 32 if 65 <= x <= 90 else x for x in m).decode() for m in re.findall(rb"[A-Za-z\x80-\xff]+", t.encode())]
    seen, n = collections.Counter(), collections.Counter()
    for t, lang, s in docs:
        seen.update({(lang, x) for x in terms(t)})
        n.update((lang, s, x) for x in terms(t))
    out = []
    for lang in {d[1] for d in docs}:
        kept = sorted(x for (g, x), k in seen.items() if g == lang and k >= least)
        groups = sorted({d[2] for d in docs if d[1] == lang})
        size = {s: sum(n[lang, s, x] for x in kept) for s in groups}
        p = {s: {x: 1 + 10**9 * (n[lang, s, x] + 5) // (size[s] + 5 * len(kept)) for x in kept} for s in groups}
        q = {x: 1 + 10**9 * (sum(n[lang, s, x] for s in groups) + 5) // (sum(size.values()) + 5 * len(kept)) for x in kept}
        for s in groups:
            far = sorted((-sum(abs(p[s][x] - p[o][x]) for x in kept), o) for o in groups if o != s)
            over = sorted((q[x] - p[s][x], x) for x in kept if n[lang, s, x] and p[s][x] > q[x])[:top]
            out += [(lang, s, part, item, -v, i + 1) for part, of in (("pair", far), ("term", over)) for i, (v, item) in enumerate(of)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 16, 7])
def test_divergence_is_brute_force(spark, docs, messy, monkeypatch, cells):
    monkeypatch.setattr(divergence, "TEMPORARY", 50)
    monkeypatch.setattr(divergence, "ENTRIES", 100)
    monkeypatch.setattr(divergence, "PIECE", 1000)
    plain = docs.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))  # the fixture's words have no letters but one
    rows = [(t and t.translate(str.maketrans("0123456789", "abcdefghij")), lang, s) for _, t, lang, s, _ in messy]
    got = sorted(tuple(r) for r in divergence.audit(plain, least=5, top=7, cells=cells).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited(rows, 5, 7) and {g[2] for g in got} == {"pair", "term"}


def test_divergence_of_odd_tables(spark, nothing):
    assert divergence.audit(nothing).count() == 0
    rows = [(None, None, "a"), ("", None, "b"), ("É É é 1 Zz", "fr", None), ("x" * 10, "fr", "a")]
    frame = spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long")
    for least in (1, 30):
        assert sorted(tuple(r) for r in divergence.audit(frame, least).select("lang", "source", "part", "item", "value", "rank").collect()) == audited(rows, least)


def test_scaled_frequencies_are_exact():
    r = random.Random(2)
    for _ in range(200):
        of = r.randrange(1, 10**14)
        count = r.randrange(of)
        assert int(divergence.scaled(np.array([count]), np.int64(of))[0]) == 1 + 10**9 * count // of


# ---- URL filters

ODD = [None, "", "no scheme", "http://", "https://A.Example.NET", "https://a.example.net/en/x?y=/de/", "https://example.net/en/", "https://badexample.net/en/1", "https://x.org/fr/", "https://x.org/fr", "HTTP://Foo.NET/Bar#f", "a://b://c.net/x", "http://example.com/de/?a=1&b=2", "http://example.com?x=/de/", "http://net/", "http://ünï.net/é", "http://u@h.net:80/p", "http://x.com/" + "a" * 50_000, "http://x.com/\n?q", "://net/"]


def plain_rule(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in url_filters.RULES if (host == r[1].split("/", 1)[0] or host.endswith("." + r[1].split("/", 1)[0])) and path.startswith("/" + r[1].split("/", 1)[1])]
    action, rule = max(fits, key=lambda r: len(r[1]), default=(None, None))
    return host, path, rule, action


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, score string")


def test_rules_and_parts_of_urls(spark):
    frame = pages(spark, ODD)
    model = url_filters.fit(url_filters.by_rules(frame), trees=2)
    got = url_filters.judged(frame, model).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [plain_rule(u)[:3] for u in ODD]
    assert all(r.verdict == plain_rule(u)[3] for r, u in zip(got, ODD) if r.rule) and {r.verdict for r in got} <= {"allow", "block"}


def test_trees_learn_what_urls_look_like(spark):
    r = random.Random(4)

    def url(bad):
        name = "".join(r.choice("0123456789abcdef" if bad else "aeilnorst") for _ in range(r.randrange(6, 14)))
        return f"http://{name}.com/" + "/".join(r.choice(["a", "b", "c"]) for _ in range(r.randrange(1, 4))) + ("?" + "&".join(f"k{i}=1" for i in range(r.randrange(0, 5))) if r.random() < 0.7 else "")

    rows = [(i, url(i % 2), i % 2 == 1) for i in range(1200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    host, path = url_filters.host_and_path(F.col("url"))
    parts = frame.withColumns({"host": host, "path": path})
    model = url_filters.fit(parts.filter("page_id < 800"), trees=5)
    assert model.trees and model.trees == url_filters.fit(parts.filter("page_id < 800").repartition(5), trees=5).trees
    got = {x.page_id: x.score for x in url_filters.judged(frame, model, rules=()).collect()}
    right = sum((got[i] > 0.5) == bad for i, _, bad in rows[800:])
    assert right > 0.85 * 400


def test_url_features(spark):
    frame = url_filters.shaped(pages(spark, ["https://a-b.example.com/x/y/1.html?q=1&r=2#top", None]).withColumns(dict(zip(("host", "path"), url_filters.host_and_path(F.col("url"))))))
    one, none = frame.orderBy("page_id").collect()
    url = "https://a-b.example.com/x/y/1.html?q=1&r=2#top"
    bits = -sum(c / len(url) * math.log2(c / len(url)) for c in collections.Counter(url).values())
    assert (one.f_length, one.f_depth, one.f_labels, one.f_hyphens, one.f_parameters, one.f_fragment, one.suffix) == (len(url), 3, 2, 1, 2, 1, "com")
    assert one.f_entropy == pytest.approx(bits) and one.f_digits == pytest.approx(3 / len(url))
    assert (none.f_length, none.f_entropy, none.f_digits, none.suffix) == (0, 0, 0, "")


def test_filters_without_both_labels(spark, nothing):
    empty = pages(spark, [])
    assert url_filters.judged(empty, url_filters.fit(url_filters.by_rules(empty))).count() == 0
    for urls, verdict in ((["http://a.com/x", None], "allow"), (["http://a.com/x", *["http://b.net/x"] * 3], "block"), (["http://a.com/x", *["http://b.org/fr/x"] * 3], "allow")):
        frame = pages(spark, urls)
        assert url_filters.judged(frame, url_filters.fit(url_filters.by_rules(frame))).filter("page_id = 0").first().verdict == verdict
