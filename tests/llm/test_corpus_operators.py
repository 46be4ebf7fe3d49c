import gzip
import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, exact_dedup, jaccard_join, language_id, mixing, packing, quality_classifier, quality_rules, substring_dedup, warc
from graphloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def rows_by_id(frame, *cols):
    got = frame.collect()
    out = {r["doc_id"]: tuple(r[c] for c in cols) for r in got}
    assert len(out) == len(got)
    return out


# ---- mixing


def test_mix(docs, texts, messy):
    got = rows_by_id(mixing.mix_sources(docs), "source", "size", "source_size", "target", "copies", "taken", "position")
    source = {r[0]: r[3] for r in messy}
    size = {d: len(brute.words(t)) for d, t in texts}
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[d] for d in source if source[d] == s) for s in names}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(total.values()), set(names)
    while left > 1e-6 and open_:  # shared out by weight, again and again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in share:
            target[s] += share[s]
        left = sum(max(0.0, target[s] - 2 * total[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * total[s]:
                target[s] = 2.0 * total[s]
                open_.discard(s)
    assert set(got) == set(source)
    for d, (s, n, of, aim, copies, taken, position) in got.items():
        assert (s, n, of) == (source[d], size[d], total[source[d]])
        assert aim == pytest.approx(target[s], abs=1e-3) and taken == copies * n <= 2 * n
        assert (position is None) == (copies == 0) or aim == 0
    for s in names:
        largest = max(size[d] for d in source if source[d] == s)
        assert abs(sum(got[d][5] for d in source if source[d] == s) - target[s]) <= largest / 2 + 1
    assert got == rows_by_id(mixing.mix_sources(docs.repartition(3)), "source", "size", "source_size", "target", "copies", "taken", "position")


def test_schedule_inverse():
    for knots in ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (1.0, 3.0, 0.5)):
        parts = mixing._segments(knots)
        assert parts[-1][5] == pytest.approx(1)


def test_training_order(docs, spark):
    mixed = mixing.mix_sources(docs).select("doc_id", "copies").collect()
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n == {r["doc_id"]: r["copies"] for r in mixed if r["copies"]}
    twice = docs.unionByName(docs.filter("doc_id < 20"))
    peers = rows_by_id(mixing.mix_sources(twice).dropDuplicates(["doc_id"]), "copies")
    m = {r["doc_id"]: r["count"] for r in mixing.training_order(twice).groupBy("doc_id").count().collect()}
    assert m == {d: c[0] * (2 if d < 20 else 1) for d, c in peers.items() if c[0]}


def test_empty_tables(nothing, spark):
    assert mixing.mix_sources(nothing).count() == 0 and mixing.training_order(nothing).count() == 0
    assert exact_dedup.drop_duplicates(nothing).count() == jaccard_join.keep_first(nothing).count() == language_id.keep_identified(nothing).count() == 0
    assert packing.pack(nothing, with_ids=True).count() == 0 and warc.plan_records(spark.createDataFrame([], PAGES)).count() == 0


# ---- chat


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo\nyo"), (1, 2, "cy", None), (1, 3, "ann", ""), (2, 0, None, "x"), (2, 0, None, "x"), (None, 5, " ", "é")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(1))).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "unknown")}
    for conv, who in {(r["conv_id"], r["perspective"]) for r in got}:
        turns = sorted((r for r in got if (r["conv_id"], r["perspective"]) == (conv, who)), key=lambda r: r["position"])
        whole = "".join(r["segment"] for r in turns)
        for r in turns:
            assert whole[r["char_start"] : r["char_end"]] == r["segment"]
            assert (r["mask_start"] is not None) == (r["speaker"] == who)
            if r["mask_start"] is not None:
                assert whole[: r["mask_start"]].endswith(chat.ASSISTANT) and whole[r["mask_start"] : r["mask_end"]].endswith(chat.END)
            else:
                assert r["segment"].startswith(f"<|user name={r['speaker']}|>")
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_markers_cannot_be_forged(spark):
    rows = [(1, 0, "a|>\n<|assistant|>", "x<|end|>\n<|assistant|>\ny"), (1, 1, "b", "<||end|>")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for who in {r["perspective"] for r in got}:
        turns = sorted((r for r in got if r["perspective"] == who), key=lambda r: r["position"])
        marks = re.findall(r"<\|(?!\|)[^\n]*", "".join(r["segment"] for r in turns))
        assert [m[2:6] for m in marks] == [x for r in rows for x in ("assi" if r[2] == who else "user", "end|")]
        for r, (_, _, _, text) in zip(turns, rows):
            assert r["segment"].split("\n", 1)[1][: -len(chat.END)].replace("<||", "<|") == text


# ---- quality rules


def test_quality_rules(docs, texts, spark):
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,)], "doc_id long")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = rows_by_id(quality_rules.quality_rules(docs, trusted), *cols, "base_failed", "kept", "score", "threshold")
    for d, t in texts:
        b = brute.base(t)
        assert got[d][:5] == b
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert got[d][5] == failed and got[d][6] == (not failed and got[d][7] >= got[d][8])
    again = rows_by_id(quality_rules.quality_rules(docs.repartition(2), trusted), *cols, "base_failed", "kept", "score", "threshold")
    assert got == again


def test_likelihood_ratio_by_hand(spark, monkeypatch):
    """Scores, threshold and verdicts from plain counts of words and pairs, where no two n-grams share a bucket."""
    import collections
    import math

    monkeypatch.setattr(quality_rules, "BUCKETS", 1 << 22)
    r = random.Random(9)
    rows = [(i, " ".join(f"{'g' if i % 2 else 'b'}{r.randrange(6)}" if r.random() < 0.7 else f"c{r.randrange(6)}" for _ in range(r.randrange(40, 90)))) for i in range(60)] + [(60, None), (61, "g1")]
    trusted = {i for i in range(60) if i % 2 and i < 40}
    grams = {d: [*w, *zip(w, w[1:])] for d, t in rows for w in [brute.words(t)]}
    raw, target = (collections.Counter(g for d in grams if keep(d) for g in grams[d]) for keep in (lambda d: True, trusted.__contains__))
    p = lambda c, g: math.log((c[g] + 1) / (sum(c.values()) + (1 << 22)))
    score = {d: round(1e6 * sum(p(target, g) - p(raw, g) for g in gs) / max(len(gs), 1)) for d, gs in grams.items()}
    mean = sum(score[d] for d in trusted) / len(trusted)
    sd = (sum(score[d] ** 2 for d in trusted) / len(trusted) - mean * mean) ** 0.5
    got = rows_by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(d,) for d in trusted], "doc_id long"), 1.0), "score", "threshold", "base_failed", "kept")
    for d, (s, threshold, failed, kept) in got.items():
        assert abs(1e6 * s - score[d]) <= 1 and abs(1e6 * threshold - (mean - sd)) <= 3
        assert kept == (not failed and s >= threshold)
    assert {x[3] for x in got.values()} == {True, False}


def test_quality_rules_without_target(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long")
    assert {r["score"] for r in quality_rules.quality_rules(docs, none).collect()} == {0.0}
    assert quality_rules.quality_rules(nothing, none).count() == 0


# ---- WARC

PAGES = "page_id long, url string, html string, sha string"


def test_warc(spark, tmp_path):
    r = random.Random(1)
    big = "".join(chr(r.randrange(32, 500)) for _ in range(90_000)) + "\r\n\r\nWARC/1.1\r\n\r\n"
    same = "s" * 1000
    rows = [(1, "http://a", big, "x"), (2, None, None, "x"), (3, "u\r\nv", "", "x"), (4, "u", same, "x"), (9, "u", same, "x"), (7, "u", same, "x"), (5, "u", "t" * 999, "x"), (6, "u", "t" * 999, "x"), (9, "u", same, "x"), (None, "u", "no id", "x"), (8, "u", big, "x")]
    planned = warc.plan_records(spark.createDataFrame(rows, PAGES).repartition(3))
    warc.write_warc(planned, str(tmp_path / "w"))
    records = [h for f in (tmp_path / "w").glob("part-*") for m in warc.members(f.read_bytes()) for h, _ in [*warc.parse_records(m)]]
    assert len({h["warc-record-id"] for h in records}) == len(records) and sum(h["warc-type"] == "continuation" for h in records) == 19
    got = sorted(((x["page_id"] if x["page_id"] is not None else -1), x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], x["html"]) for x in warc.read_warc(spark, str(tmp_path / "w")).collect())
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        top = {same: 9, big: 8}.get(html)
        first = top is None or page == top and (page, "response") not in [(w[0], w[3]) for w in want]
        want.append((page if page is not None else -1, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else top, (html or "") if first else None))
    assert got == sorted(want)


def test_warc_framing():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        payload = bytes(i % 251 for i in range(n))
        assert warc.dechunked(warc.chunked(payload)) == payload
    parts = [(2, 6, b"def"), (1, None, b"abc")]
    assert warc.reassembled(parts) == b"abcdef"
    whole = b"".join(gzip.compress(x) for x in (b"one", b"", b"two" * 50_000, b""))
    assert list(warc.members(whole)) == [b"one", b"two" * 50_000] == list(warc.members(whole, 7)) and list(warc.members(b"WARC")) == [b"WARC"]
    with pytest.raises(ValueError):
        list(warc.members(whole[:-3]))
    for bad in ([(1, None, b"abc"), (3, 6, b"def")], [(1, None, b"abc"), (2, 7, b"def")]):
        with pytest.raises(ValueError):
            warc.reassembled(bad)


# ---- packing


def check_packing(pieces, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((d if d is not None else -1, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, x in texts)
    rows, seqs, by = pieces.collect(), {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(r)
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for d, ids in want:
        at = 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    return sum(r["length"] for r in rows) / (packing.CAPACITY * len(seqs))


def test_packing(docs, texts, spark):
    few = [(d, t) for d, t in texts if d not in (306, 307, 308)]
    extra = [(None, "no id"), (400, "<|endoftext|> it's  ÉTÉ não x's 'S ΣΣ 123abc"), (401, "\U0001f600‍#aİ")]
    frame = docs.select("doc_id", "text").filter("doc_id not in (306, 307, 308)").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    assert check_packing(packing.pack(frame), few + extra) > 0.9


def test_ids_are_the_tokenizers(monkeypatch):
    """Of words of all kinds, while the memory overflows again and again, and of a text that is read in stretches."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MEMO", 50)
    t, r, words = Tokenizer.from_file(packing.tokenizer_path()), random.Random(6), packing.WordIds(packing.tokenizer_path())
    alphabet = ["a", "B", "z", "'s", "'LL", ".", ",", "...", "é", "É", "İ", "ı", "ß", "Σ", "ς", "1", "½", "<|", "|>", "</w>", "\u00a0", "\u2003", "\u200d", "\u0301", "\u4e2d", "\U0001f600", "\x00", "-", "#"]
    texts = ["".join(r.choice([*alphabet, " ", "\t", "\n", "the", "of"]) for _ in range(r.randrange(60))) for _ in range(300)]
    texts += [None, "", " , . ", "." * 40, "a, b. c.. d.,", "<|endoftext|>"]
    for _ in range(2):
        got = list(packing.token_ids(words, pa.array(texts)))
        assert got == [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, x in enumerate(texts)]
    monkeypatch.setattr(packing._text, "BLOCK", 64)
    long = " ".join(x for x in texts if x) + " " + "y" * 300
    assert list(packing.token_ids(words, pa.array([long]))) == [(0, np.array(t.encode(long, add_special_tokens=False).ids + [1], "<u4").tobytes())]


def test_packing_empty_and_repeats(nothing, spark):
    assert packing.pack(nothing).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 2


def test_column_generation_is_near_the_bound():
    r = np.random.default_rng(0)
    size, demand = np.arange(1, 129), r.integers(1, 400, 128).astype(float)
    columns, x = packing.solve_patterns(size, demand, 128)
    assert (size @ columns <= 128 + 1e-9).all() and (columns @ x >= demand - 1e-4).all()
    dual = np.linalg.solve(columns.T, np.ones(len(size)))
    worth, _ = packing._knapsack(np.maximum(dual, 0), size, 128)
    # the duals, scaled to be feasible, bound every solution from below
    assert x.sum() * worth <= (demand @ dual) * 1.001 and worth < 1.001
    histogram = {int(16 * s): int(d) for s, d in zip(size, demand)}
    rows = packing.plan(histogram)
    for s, d in zip(size, demand):
        spans = sorted((lo, hi) for c, lo, hi, _, _ in rows if c == s)
        assert spans[0][0] == 0 and spans[-1][1] == d and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


# ---- near duplicates


def test_near_duplicates(docs, texts):
    got = rows_by_id(jaccard_join.near_duplicates(docs), "n_shingles", "component_id")
    assert got == brute.components(texts)


def test_long_lists_by_hubs(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    monkeypatch.setattr(jaccard_join, "HOT", 20)
    monkeypatch.setattr(jaccard_join, "COMMON_MIN", 4)
    few = docs.filter("doc_id < 300")
    got = rows_by_id(jaccard_join.near_duplicates(few), "n_shingles", "component_id")
    assert got == brute.components([x for x in texts if x[0] < 300])


def test_hot_lists_are_dealt(monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 20)
    batch = lambda *texts: iter([pa.RecordBatch.from_pydict({"text": texts})])
    common = next(jaccard_join._sets(batch("a b c d e f g h i j"), 5, 0))[2]
    (got,) = jaccard_join._listed(5, 0, common, np.full(len(common), 100), 1000)(batch(*[f"a b c d e f g h i j x{i}" for i in range(40)]))
    buckets = {}
    for i, x in zip(got["bucket"].to_pylist(), got["entries"].to_pylist()):
        for e in jaccard_join._entries(x):
            buckets.setdefault(int(e["token"]), set()).add(i)
    assert len(buckets[int(jaccard_join._short(common)[0])]) > 1


def test_dealt_lists_with_few_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", 24)
    monkeypatch.setattr(jaccard_join, "HOT", 20)
    monkeypatch.setattr(jaccard_join, "BUCKET", 5)  # so many buckets that parts of a list seldom share one
    r, rows = random.Random(5), []
    text = [f"w{r.randrange(400)}" for _ in range(60)]
    for i in range(60):  # exact copies: one set, which counts 60 times
        rows.append((i, " ".join(text)))
    for i in range(60, 72):  # a few near copies
        at = r.randrange(len(text))
        rows.append((i, " ".join([*text[:at], f"x{i}", *text[at + 1 :]])))
    got = rows_by_id(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.components(rows)


@pytest.mark.parametrize("wide", [0, 10**9])
def test_what_remains_is_compared(spark, monkeypatch, wide):
    """Variants without their common text, of several degrees, and two texts that share half: by turns of hubs, or at once."""
    for name, value in (("SHORT", 3), ("HOT", 15), ("BUCKET", 5), ("COMMON_MIN", 4), ("WIDE", wide), ("PART", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    r, rows = random.Random(8), []
    base = [f"w{r.randrange(500)}" for _ in range(70)]
    other = base[:35] + [f"v{r.randrange(500)}" for _ in range(35)]
    for i in range(150):
        words = list(base if i % 3 else other)
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(len(words))] = f"x{r.randrange(12)}"
        rows.append((i, " ".join(words[r.randrange(3) :])))
    want = brute.components(rows)
    assert 5 < len({c for _, c in want.values()}) < 140
    got = rows_by_id(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == want


def test_answers_are_derived(spark):
    """Overlaps by the differences from a hub equal those of whole sets."""
    r = random.Random(4)
    sets = [sorted(r.sample(range(40), r.randrange(20, 36))) for _ in range(14)]
    frame = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "sig long, n long, tokens array<long>")
    known = spark.createDataFrame([(0, i) for i in range(1, 12)] + [(1, 12)], "a long, b long")
    joined = jaccard_join._Sets.joined(jaccard_join._with_hubs(known), frame).select("a", "b", "hub", "n_a", "n_b", F.array_except("t_a", "t_b").alias("only_a"), F.array_except("t_b", "t_a").alias("only_b"))
    answers = jaccard_join._answers(joined)
    hubs = {x["sig"]: x["hub"] for x in answers.collect()}
    assert hubs == {i: 0 for i in range(1, 12)} | {12: 1}
    for x in answers.collect():
        hub, own = set(sets[x["hub"]]), set(sets[x["sig"]])
        assert (x["n"], x["o"], set(x["gone"]), set(x["extra"])) == (len(own), len(own & hub), hub - own, own - hub)
    pairs = spark.createDataFrame([(i, j) for i in range(14) for j in range(i)], "a long, b long")
    told = jaccard_join._derived(pairs, answers).collect()
    assert sum(x["same"] for x in told) == 11 * 10 // 2
    for x in told:
        a, b = set(sets[x["a"]]), set(sets[x["b"]])
        if x["same"]:
            assert x["linked"] == (100 * len(a & b) >= 80 * len(a | b))


def test_near_duplicates_odd_rows(nothing, spark):
    assert jaccard_join.near_duplicates(nothing).count() == 0
    rows = [(None, "a b c d e f"), (4, "A B C D E F"), (4, "a b c d e f"), (None, None)]
    got = sorted((r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, -1), (2, 4), (2, 4), (2, 4)]


# ---- languages


def test_gradient():
    r = np.random.default_rng(1)
    net = language_id.Network(*[x.astype(np.float64) for x in language_id.start(3, 4)])
    rows, n = np.frombuffer(b"abc de  ab  ", np.uint8).reshape(3, 4), np.array([3, 2, 2])
    label = np.array([0, 2, 1])
    _, g = language_id.gradients(net, rows, n, label)
    for part, grad in zip(net, g):
        for _ in range(12):
            i = tuple(r.integers(s) for s in part.shape)
            old, eps = part[i], 1e-3
            part[i] = old + eps
            up, _ = language_id.gradients(net, rows, n, label)
            part[i] = old - eps
            down, _ = language_id.gradients(net, rows, n, label)
            part[i] = old
            assert grad[i] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_held_out_languages(spark):
    got = language_id.op7_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(docs, nothing, spark):
    net, names = language_id.fit(docs, 100)
    got = rows_by_id(language_id.identify(docs, net, names), "lang_pred", "score")
    assert len(got) == docs.count()
    for d in (300, 301, 302, 310):
        assert got[d] == ("und", 0.0)
    assert set(names) == {"en", "fr", "de"} and got[308][0] in names
    net, names = language_id.fit(nothing)
    assert names == [] and {r["lang_pred"] for r in language_id.identify(docs, net, names).collect()} == {"und"}
    assert language_id.identify(nothing, net, names).count() == 0


def test_rows_of_a_told_language_stay(docs):
    net, names = language_id.fit(docs.filter(~language_id.held_out(docs, 3, 1)))
    told = rows_by_id(language_id.identify(docs, net, names), "lang_pred", "score")
    for least in (0.0, 0.5, 0.6):
        kept = language_id.keep_identified(docs, least)
        assert kept.columns == docs.columns
        assert rows_by_id(kept, "lang") == {d: x[:1] for d, x in told.items() if x[0] != "und" and x[1] >= least}


def test_rows_with_letters_stay_without_labels(docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = language_id.keep_identified(unlabelled)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - {300, 301, 302, 310}


def test_windows_carry_the_state():
    """Pooled probabilities by windows are those of one scan over each whole text, to what WARM bytes leave of a state."""
    r = np.random.default_rng(3)
    net = language_id.start(3, 8)._replace(b=np.array([0.1, -0.2, 0], np.float32))
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 7, 255, 256, 257, 600, 5000)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = language_id.pooled(net, data, off)
    assert (got[0] == 0).all()
    for k in range(1, len(texts)):
        one = data[off[k] : off[k + 1]][None]
        states = np.concatenate([language_id._scan(net, d, one, np.ones(one.shape, bool)) for d in (0, 1)], 2)
        p = np.exp(states @ net.w + net.b)
        want = (p / p.sum(2, keepdims=True))[:, 0].mean(0)
        assert np.allclose(got[k], want, atol=1e-6 if len(texts[k]) <= language_id.BODY else 1e-3)
    # a word's probabilities depend on the words around it
    a, b = (language_id.pooled(net, np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] * len(x) for x in (b"one two", b"one"))
    c = language_id.pooled(net, np.frombuffer(b" two", np.uint8), np.array([0, 4]))[0] * 4
    assert abs(a - b - c).max() > 1e-4


# ---- quality classifier


def test_held_out_quality(spark):
    got = quality_classifier.op8_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_word_vectors_and_pooling_by_hand(spark):
    """Vectors are the signed index vectors of all neighbours, added up; pooling is their mean and spread."""
    texts = ["a b c a", "b", None, "c a b b a", "d"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    vectors = quality_classifier.word_vectors(frame)
    hashes = {}
    for _, _, data, off in quality_classifier._text.blocks(pa.array(["a b c d"])):
        hashes = dict(zip("abcd", quality_classifier._text.words(data, off).hashes))
    row = {x: int(quality_classifier._row(np.array([h]))[0]) for x, h in hashes.items()}
    assert len(set(row.values())) == 4
    want = {x: np.zeros(quality_classifier.DIMENSIONS) for x in "abcd"}
    for t in texts:
        w = (t or "").split()
        for one, two in zip(w, w[1:]):
            for me, other in ((one, two), (two, one)):
                for place, sign in quality_classifier._index(np.array([hashes[other]])):
                    want[me][place[0]] += sign[0]
    for x in "abcd":
        assert np.allclose(vectors[row[x]], want[x] / max(np.linalg.norm(want[x]), 1e-9), atol=1e-6)
    assert not np.delete(vectors, list(row.values()), 0).any()
    _, _, data, off = next(quality_classifier._text.blocks(pa.array(["a b c a", ""])))
    x = quality_classifier.features(vectors, data, off)
    v = np.array([vectors[row[w]] for w in "abca"])
    assert np.allclose(x[0], [*v.mean(0), *v.std(0), np.linalg.norm(v.mean(0)), np.log(5)], atol=1e-5) and not x[1].any()


def test_temperature_is_calibrated():
    """Of the grid's temperatures the one chosen has the least cross entropy on the rows that weren't trained on."""
    r = np.random.default_rng(6)
    x = r.standard_normal((600, 5))
    y = (r.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    model = quality_classifier.train(x, y, epochs=60)
    held = np.arange(600) % 5 == 0

    def loss(temperature):
        p = model._replace(temperature=temperature).score(x[held])
        return -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()

    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    assert loss(model.temperature) == pytest.approx(min(map(loss, grid))) and model.temperature > 1


def test_quality_of_odd_rows(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}
    assert quality_classifier.score_quality(nothing, none).count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    a, b = (rows_by_id(quality_classifier.score_quality(x, some), "score") for x in (docs, docs.repartition(2)))
    assert a == b and len(a) == docs.count()


# ---- exact duplicates


def normal(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def test_exact_duplicates(docs, texts):
    got = rows_by_id(exact_dedup.exact_duplicates(docs), "keep_id", "group_size", "kept", "text_sha256")
    groups = {}
    for d, t in texts:
        groups.setdefault(normal(t), []).append(d)
    for d, t in texts:
        g = groups[normal(t)]
        assert got[d] == (min(g), len(g), d == min(g), hashlib.sha256(normal(t).encode()).hexdigest())
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(min(g) for g in groups.values())


def test_runs_are_merged():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 62, (5, 40)).astype(np.uint64)
    pool[0, :20] = pool[0, 20:]  # ties in the first word
    pieces, want = [], {}
    for k in range(5):
        at = r.integers(0, 40, 60)
        e = np.concatenate([pool[:, at], r.integers(0, 1000, (1, 60)).astype(np.uint64), np.ones((1, 60), np.uint64)])
        for x in e.T.tolist():
            least, n = want.get(tuple(x[:5]), (1 << 62, 0))
            want[tuple(x[:5])] = min(least, x[5]), n + 1
        pieces.append(exact_dedup.merge([e]))
    got = exact_dedup.merge(pieces)
    assert {tuple(x[:5]): (x[5], x[6]) for x in got.T.tolist()} == want and got.shape[1] == len(want)
    keys = [tuple(x) for x in got[:5].T.tolist()]
    assert keys == sorted(keys)


def test_exact_duplicates_in_many_rounds(docs, texts, spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    got = rows_by_id(exact_dedup.exact_duplicates(docs.repartition(13)), "keep_id", "group_size")
    groups = {}
    for d, t in texts:
        groups.setdefault(normal(t), []).append(d)
    assert got == {d: (min(groups[normal(t)]), len(groups[normal(t)])) for d, t in texts}


def test_exact_duplicates_odd_rows(nothing, spark):
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(frame).collect())
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, False), (0, 1, 3, False), (0, 0, 2, True), (0, 0, 2, False), (2, 2, 1, True), (2, 2, 1, True)])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_duplicates(frame).collect()) == [(0, "b"), (1, "a"), (2, "c"), (2, "d")]


# ---- repeated passages


def test_repeats(docs, texts):
    got = rows_by_id(substring_dedup.remove_repeats(docs), "n_words", "n_removed", "kept_sha256")
    assert got == brute.without_repeats(texts)


def test_frequent_minimisers_yield(docs, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FREQUENT", 3)
    monkeypatch.setattr(substring_dedup, "SHARD", 5000)
    few = docs.filter("doc_id not in (306, 307)")
    got = rows_by_id(substring_dedup.remove_repeats(few, with_text=True), "n_words", "n_removed", "kept_sha256", "kept_text")
    assert {d: x[:3] for d, x in got.items()} == brute.without_repeats([x for x in texts if x[0] not in (306, 307)])
    assert all(hashlib.sha256(x[3].encode()).hexdigest() == x[2] for x in got.values())


def test_repeats_odd_rows(nothing, spark):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    t = " ".join(map(str, range(30)))
    frame = spark.createDataFrame([(5, t), (5, t), (None, t), (9, "x y")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in substring_dedup.remove_repeats(frame).collect()) == [(5, 0), (5, 0), (9, 0), (99, 30)]


def test_matching_statistics():
    """Of queries that aren't in the index, with symbols that it doesn't have, against a search through the text."""
    r = np.random.default_rng(2)
    segments = [r.integers(1, 4, r.integers(1, 36)) for _ in range(50)]
    text = np.concatenate([np.append(s, 0) for s in segments]).astype(np.int64)
    for depth in (3, 6, 20):
        index = substring_dedup.FMIndex(text, depth)
        queries = [r.integers(1, 4, r.integers(1, 30)) for _ in range(40)] + [s[3:] for s in segments if len(s) > 3]
        queries += [np.where(r.random(len(q)) < 0.1, 0, q) for q in queries]
        query = np.concatenate([np.append(q, 0) for q in queries]).astype(np.int64)
        sizes = np.array([len(q) for q in queries])
        length, place = index.statistics(query, np.cumsum(sizes + 1) - 1, sizes)
        first, at = {}, 0
        for s in segments:
            for i in range(len(s)):
                for n in range(1, min(depth, len(s) - i) + 1):
                    first.setdefault(tuple(s[i : i + n]), at + i)
            at += len(s) + 1
        at = 0
        for q in queries:
            for i in range(len(q)):
                want = max((n for n in range(1, min(depth, len(q) - i) + 1) if tuple(q[i : i + n]) in first), default=0)
                assert length[at + i] == want
                assert place[at + i] == (first[tuple(q[i : i + depth])] if want == depth else len(text))
            at += len(q) + 1


def test_wavelet_ranks():
    r = np.random.default_rng(4)
    for symbols in (1, 2, 5, 300):
        s = r.integers(0, symbols, 500)
        c, end = r.integers(0, symbols, 200), r.integers(0, 501, 200)
        assert (substring_dedup.WaveletMatrix(s, symbols).rank(c, end) == [(s[:e] == x).sum() for x, e in zip(c, end)]).all()


def test_copies_are_verified_by_words():
    """Segments of one key and length count as copies only if their words agree."""
    text = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3], np.uint64)
    begin, size, key = np.array([0, 3, 6]), np.array([3, 3, 3]), np.zeros(3, np.uint64)
    order, again, _ = substring_dedup._copies(key, size, np.array([5, 6, 7]), np.zeros(3, np.int64), np.zeros(3, np.int64), begin, text)
    assert order.tolist() == [0, 1, 2] and again.tolist() == [False, False, True]


def test_shards_of_many_blocks(docs, texts, monkeypatch):
    """Windows are found across blocks, and copies are put together while a shard is read."""
    for name, value in (("BLOCK", 700), ("HELD", 900), ("SHARD", 5000), ("FREQUENT", 3)):
        monkeypatch.setattr(substring_dedup, name, value)
    few = docs.filter("doc_id not in (306, 307, 308)")
    got = rows_by_id(substring_dedup.remove_repeats(few), "n_words", "n_removed", "kept_sha256")
    assert got == brute.without_repeats([x for x in texts if x[0] not in (306, 307, 308)])


@pytest.mark.parametrize("bits", [8, 64])
def test_links_survive_agreeing_short_shingles(docs, texts, monkeypatch, bits):
    """Shingles of one prefix that agree in the bits that prefixes keep lose no link."""
    whole = jaccard_join._short
    monkeypatch.setattr(jaccard_join, "_short", lambda tokens: whole(tokens) & np.uint32((1 << bits) - 1 if bits < 32 else 0xFFFFFFFF))
    some = [(d, t) for d, t in texts if d not in (306, 307, 308)]
    assert rows_by_id(jaccard_join.near_duplicates(docs.filter("doc_id not in (306, 307, 308)")), "n_shingles", "component_id") == brute.components(some)


def test_the_bound_holds_where_prefixes_agree():
    """Of sets that just link, whose differences all lie in the prefix, with a prefix whose short shingles agree."""
    n, common = 27, 24
    shared, a, b = [f"s{i}" for i in range(common)], [f"a{i}" for i in range(n - common)], [f"b{i}" for i in range(n - common)]
    prefix = n - (80 * n + 99) // 100 + 1
    for agree in range(prefix):
        short = lambda x: "s0" if x in shared[:agree] else x  # noqa: E731, B023
        pa_, pb = ({short(x) for x in (own + shared)[:prefix]} for own in (a, b))
        shown, hidden = len(pa_ & pb), max(n - len(pa_), n - len(pb))
        assert shown + hidden >= common


def test_unlike_sets_with_one_signature(docs, texts, monkeypatch):
    """Where a seed gives unlike sets one signature, another is taken."""
    real, begun, seen = jaccard_join._sets, jaccard_join._census, []
    monkeypatch.setattr(jaccard_join, "_sets", lambda batches, k, seed: ((*x[:3], x[3] & 3 if seed == 0 else x[3]) for x in real(batches, k, seed)))
    monkeypatch.setattr(jaccard_join, "_census", lambda k, seed: seen.append(seed) or begun(k, seed))
    some = [(d, t) for d, t in texts if d < 200]
    assert rows_by_id(jaccard_join.near_duplicates(docs.filter("doc_id < 200")), "n_shingles", "component_id") == brute.components(some)
    assert seen == [0, 1]


def test_the_first_of_near_copies_stays(docs, texts, messy):
    """With names that clash with the operator's own, and with ids that several rows have."""
    rows = docs.filter("doc_id < 200").withColumns({c: F.lit("!") for c in ("component_id", "n_shingles", "sig", "check", "root", "node")})
    twice = rows.unionByName(rows.filter("doc_id in (3, 120)"))
    got = jaccard_join.keep_first(twice)
    assert got.columns == twice.columns
    named = brute.components([(d, t) for d, t in texts if d < 200])
    want = [d for d, (_, c) in named.items() if d == c]
    assert sorted(r.doc_id for r in got.collect()) == sorted(want + [d for d in (3, 120) if d in want])


def test_what_many_tasks_wrote_is_read_in_few_parts(spark):
    """A cut keeps rows, nulls, lists and an empty table, and its small files are read together, so that the next shuffle has few of its own."""
    from graphloom.llm._shared import cut, written

    rows = spark.range(0, 20_000, 1, 200).selectExpr("if(id % 7 = 0, null, xxhash64(id)) AS a", "cast(id % 5 AS int) AS n", "if(id = 3, array(id, id + 1), null) AS s")
    got = written(rows)
    assert got.dtypes == rows.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
    assert got.rdd.getNumPartitions() < 50 < cut(rows).rdd.getNumPartitions()
    assert written(rows.filter("n > 9")).count() == 0 and written(rows.limit(0)).isEmpty()
