"""Similarity join of documents by the Jaccard index of their word shingles, with set-relation skipping.

Sets are ordered with the corpus' common shingles last; a set of size n is listed under its first
n - ceil(0.8 n) + 1 shingles, since two sets that link share one of these. An index list is in
order of (size, position) and is skipped by blocks of one size and position: all entries of a
block pass or fail the bounds on size and on what can still be shared together. Equal sets are one
entry. In a list over SHORT not all pairs are made. First, each entry is paired with one hub that it can
reach, the set with the fewest rarer shingles, and their differences are kept as the entry's answer.
What links with a hub is in its class, and pairs within a class are never looked at. While lists
still hold many pairs of different classes, all entries are paired with hubs of the largest
classes, again and again. Pairs of short lists wait until then. What remains outside of a list's largest class is compared with all
of the list. There two sets with one hub are skipped if their answers rule a link out, and else
their overlap is derived from these, by the shingles in which they differ from the hub; the texts
aren't read again. No link between different classes is lost, and a group of near copies of a text
costs as many comparisons as it has members, not its square. A list that is dealt over several
buckets counts as long in each, however few entries its part has, so that entries of different
buckets meet where what remains is paired.

A candidate pair's prefixes are compared before whole sets. Shingles are 64-bit hashes, and a whole set is
known by a 64-bit signature, which is verified by its size and another. A list is dealt over several buckets if
its shingle is one of the COMMON most frequent, as counted where some chunk has LOCAL_MIN of it; rarer
shingles' lists lie whole in one bucket each. Where pairs meet their sets, adaptive execution splits a hub's.

Defined cases: A-Z are folded; with fewer words than a shingle the whole sequence is the one
shingle; without words the set is empty and the document linked with nothing; repeated rows and
copies share a component; a null doc_id is never a component's name unless all its members have
none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _text
from graphloom.llm._shared import bloom, in_bloom, partitions, trimmed, written
from graphloom.operators.components import components

WORDS, SHARE = 5, 80
#: Shingles are counted as common from COMMON_MIN occurrences on; the COMMON most frequent are ordered last.
COMMON, COMMON_MIN, LOCAL_MIN = 1 << 16, 64, 4
#: Entries in one bucket of lists, on average; a list longer than HOT is dealt over several.
BUCKET, HOT = 400_000, 50_000
#: All pairs are made of lists up to this length; longer ones go by hubs.
SHORT = 6
#: Hubs are paired in further turns while long lists hold more than WIDE pairs of different classes an entry, and these get fewer.
WIDE, HUBS = 200, 4
#: Entries of a list, on average, that what remains is compared with in one task.
PART = 4096
SALTS = 64
_ENTRY = np.dtype([("token", "<u4"), ("sig", "<u8"), ("n", "<u4"), ("pos", "<u4")])
_U = np.uint64


def _short(tokens: np.ndarray) -> np.ndarray:
    """32 bits of shingles: within a bucket, which other bits choose, two of them seldom agree, and then only add a candidate.

    Where a prefix has two that agree, what it hides counts as one more.
    """
    return (_text.mix(tokens) >> _U(32)).astype(np.uint32)


def _entries(blob: bytes) -> np.ndarray:
    m, at = len(blob) // _ENTRY.itemsize, 0
    out = np.empty(m, _ENTRY)
    for c in _ENTRY.names:
        out[c] = np.frombuffer(blob, _ENTRY[c], m, at)
        at += m * _ENTRY[c].itemsize
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, int]]:
    """(batch, row, distinct sorted shingles, signature) of every text; the signature is of the whole set, by the seed."""
    for batch in batches:
        for lo, hi, data, off in _text.blocks(batch.column("text")):
            w = _text.words(data, off, fold=True)
            g = _text.grams(w.hashes, k)
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                if b - a >= k:
                    s = np.unique(g[a : b - k + 1])
                elif b > a:
                    s = _text.grams(w.hashes[a:b], b - a) ^ _U(b - a)
                else:
                    yield batch, lo + i, np.zeros(0, np.uint64), 0
                    continue
                yield batch, lo + i, s, signature(s, seed)


def signature(s: np.ndarray, seed: int = 0) -> int:
    with np.errstate(over="ignore"):
        salt = _U(0x5851F42D4C957F2D) + _U(seed) * _U(0xDA942042E4DD58B5)
    return int(_text.mix(np.array([_text.mix(s + salt).sum(dtype=np.uint64) ^ _U(len(s))], np.uint64))[0])


#: The seed of the second signature, by which equal ones are verified; no run takes it for its first.
CHECK = 1 << 20


def _census(k: int, seed: int, chunk: int = 1 << 21):
    """Rows (doc_id, n, sig, check) of every text, and (token, count) of shingles that are frequent where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        size = 0

        def out(tokens: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            ids, n, sig, check = zip(*rows) if rows else ((), (), (), ())
            none = lambda m: pa.nulls(m, pa.int64())
            m, t = len(rows), len(tokens)
            told = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sig, check))]
            cols = [*(pa.concat_arrays([x, none(t)]) for x in told), pa.concat_arrays([none(m), pa.array(tokens.view(np.int64))]), pa.concat_arrays([none(m), pa.array(counts)])]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "sig", "check", "token", "count"])

        def counted() -> tuple[np.ndarray, np.ndarray]:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= LOCAL_MIN
            return tokens[often], counts[often]

        for batch, row, s, sig in _sets(batches, k, seed):
            rows.append((batch.column("doc_id")[row].as_py(), len(s), sig, signature(s, CHECK)))
            held.append(s)
            size += len(s)
            if size >= chunk:
                yield out(*counted())
                rows, held, size = [], [], 0
        yield out(*counted())

    return run


def _ordered(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set with its common shingles last, the most frequent at the end."""
    if not len(common):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    hit = common[at] == s
    if not hit.any():
        return s
    late = s[hit]
    return np.concatenate([s[~hit], late[np.argsort(rank[at[hit]], kind="stable")]])


def _listed(k: int, seed: int, common: np.ndarray, counts: np.ndarray, buckets: int, chunk: int = 1 << 19):
    """Rows (bucket, entries): the prefix entries of each distinct set, dealt by token."""
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")
    hot = counts > HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size, seen = 0, set()

        def out() -> pa.RecordBatch:
            e = np.empty(size, _ENTRY)
            deal = np.concatenate([p[0] for p in parts])  # all 64 bits: those of an entry's token don't tell common shingles
            e["token"] = _short(deal)
            m = [len(p[0]) for p in parts]
            e["sig"] = np.repeat(np.array([p[1] for p in parts], np.uint64), m)
            e["n"] = np.repeat([p[2] for p in parts], m)
            e["pos"] = np.concatenate([np.arange(x) for x in m])
            if hot.any():
                at = np.minimum(np.searchsorted(common, deal), len(common) - 1)
                is_hot = (common[at] == deal) & hot[at]
                ways = (counts[at] // HOT + 1).astype(np.uint64)
                deal[is_hot] += (e["sig"] % ways)[is_hot] * _U(0x9E3779B97F4A7C15)
            bucket = ((_text.mix(deal) & _U(0xFFFFFFFF)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            # column by column, which is what compresses
            cells = [b"".join(e[c][i:j].tobytes() for c in _ENTRY.names) for i, j in zip(at, np.append(at[1:], len(e)))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(cells, pa.binary())], names=["bucket", "entries"])

        for _, _, s, sig in _sets(batches, k, seed):
            n = len(s)
            if not n or (sig, n) in seen:
                continue
            seen.add((sig, n))
            prefix = n - (SHARE * n + 99) // 100 + 1
            parts.append((_ordered(s, common, rank)[:prefix], sig, n))
            size += prefix
            if size >= chunk:
                yield out()
                parts, size, seen = [], 0, set()
        if parts:
            yield out()

    return run


def _may_link(n1, p1, n2, p2):
    """For n1 <= n2: whether sets of these sizes whose first shared shingle is at these positions can link."""
    need = (4 * (n1 + n2) + 8) // 9
    return (5 * n1 >= 4 * n2) & (p1 <= n1 - (8 * n1 + 8) // 9) & (np.minimum(n1 - p1, n2 - p2) >= need)


def _linkable(n1, p1, n2, p2):
    """_may_link for sizes in either order."""
    swap = n1 > n2
    return _may_link(np.where(swap, n2, n1), np.where(swap, p2, p1), np.where(swap, n1, n2), np.where(swap, p1, p2))


def _blocks(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs with one size and position in a list in order."""
    first = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (p[1:] != p[:-1])))
    return first, np.diff(np.append(first, len(n)))


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of the runs that start at first."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _by_hubs(n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (hub, entry) of one list in order: every entry that some earlier hub can reach is paired with one.

    The set with the smallest part of rarer shingles before the list's is the hub: of a text and
    its variants that is the text, since what a variant has of its own is rarer.
    """
    first, count = _blocks(n, p)
    bn, bp, todo = n[first], p[first], np.ones(len(first), bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h in np.lexsort((bn, bp / bn)):
        if not todo[h]:
            continue
        reach = _linkable(bn[h], bp[h], bn, bp) & todo
        todo &= ~reach
        todo[h] = False
        at = _spread(first[reach], count[reach])
        at = at[at != first[h]]
        left.append(np.full(len(at), first[h]))
        right.append(at)
    return np.concatenate(left), np.concatenate(right)


_CANDIDATE = "a long, b long, token long, n int, pos int"


def _pair_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).view(np.int64)


def _candidates(dealt: np.ndarray):
    """From rows (bucket, entries): candidate pairs (a, b) with n 1 where one is a hub, and the entries of long lists (a, token, n, pos).

    dealt: the tokens whose lists lie in several buckets; all their entries count as those of long lists.
    """

    def emit(a, b, by_hub: bool) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 1 << 18):
            pair = _pair_rows(a[i : i + (1 << 18)], b[i : i + (1 << 18)])
            m = len(pair)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.nulls(m, pa.int64()), pa.array(np.full(m, by_hub, np.int32)), pa.nulls(m, pa.int32())], names=["a", "b", "token", "n", "pos"])

    def lists(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(e["token"], kind="stable")
        t = e["token"][order]
        same = t[1:] == t[:-1]
        multi = np.append(False, same) | np.append(same, False)
        e = e[order[multi | np.isin(t, dealt)]]
        e = e[np.lexsort((e["sig"], e["pos"], e["n"], e["token"]))]
        e = e[np.append(True, (e["token"][1:] != e["token"][:-1]) | (e["sig"][1:] != e["sig"][:-1]))[: len(e)]]
        tok, sig, n, p = e["token"], e["sig"], e["n"].astype(np.int64), e["pos"].astype(np.int64)
        first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))[: len(e)]
        size = np.diff(np.append(first, len(e)))
        short = np.repeat(size <= SHORT, size)

        def listed(at: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sig[at].view(np.int64)), pa.nulls(len(at), pa.int64()), pa.array(tok[at].astype(np.int64)), pa.array(n[at].astype(np.int32)), pa.array(p[at].astype(np.int32))], names=["a", "b", "token", "n", "pos"])

        a, b = [], []
        idx = np.flatnonzero(short)
        for gap in range(1, SHORT):
            if len(idx) and idx[-1] + gap >= len(e):
                idx = idx[idx + gap < len(e)]
            idx = idx[tok[idx] == tok[idx + gap]]
            if not len(idx):
                break
            ok = idx[_may_link(n[idx], p[idx], n[idx + gap], p[idx + gap])]
            a.append(sig[ok])
            b.append(sig[ok + gap])
        if a:
            yield from emit(np.concatenate(a), np.concatenate(b), False)
        part = np.flatnonzero(short & np.isin(tok, dealt))
        if len(part):
            yield listed(part)
        left, right = [], []
        for f, m in zip(first[size > SHORT], size[size > SHORT]):
            s = slice(f, f + m)
            x, y = _by_hubs(n[s], p[s])
            left.append(sig[s][x])
            right.append(sig[s][y])
            yield listed(np.arange(f, f + m))
        if left:
            yield from emit(np.concatenate(left), np.concatenate(right), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            raw = batch.column("entries")
            for i, x in enumerate(batch.column("bucket").to_pylist()):
                if x != bucket and held:
                    yield from lists(np.concatenate(held))
                    held = []
                bucket = x
                held.append(_entries(raw[i].as_py()))
        if held:
            yield from lists(np.concatenate(held))

    return run


def _derivable(n1, o1, n2, o2):
    """Whether sets that share o1 and o2 shingles with one hub can link: at most the lesser of these, and of what lies outside of the hub."""
    return np.minimum(o1, o2) + np.minimum(n1 - o1, n2 - o2) >= (4 * (n1 + n2) + 8) // 9


_REST = "token long, part int, probe boolean, a long, n int, pos int, label long, hub long, o int"


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows _REST, in order of (token, part, probe): pairs of a probe and an entry of its part that may link, of different labels.

    A part's entries are held, its probes are streamed. A probe's bounds are looked at block by block.
    """
    fields = [x.split()[0] for x in _REST.split(", ")]
    key, held, made, size = None, [], [], 0

    def index() -> tuple[np.ndarray, ...]:
        e = {c: np.concatenate([h[c] for h in held]) for c in fields[3:]}
        e = {c: v[np.lexsort((e["pos"], e["n"]))] for c, v in e.items()}
        return e, *_blocks(e["n"], e["pos"])

    def out() -> pa.RecordBatch:
        pair = _pair_rows(*(np.concatenate(x) for x in zip(*made)))
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    found = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in fields}
        change = np.zeros(batch.num_rows, bool)
        for c in fields[:3]:
            change[1:] |= col[c][1:] != col[c][:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:]):
            if (now := (int(col["token"][i]), int(col["part"][i]))) != key:
                key, held, found = now, [], None
            here = {c: col[c][i:j] if c in ("a", "label", "hub") else col[c][i:j].astype(np.int64) for c in fields[3:]}
            if not col["probe"][i]:
                held.append(here)
                continue
            if not held:
                continue
            e, first, count = found = found or index()
            bn, bp = e["n"][first], e["pos"][first]
            for k in range(j - i):
                q = {c: v[k] for c, v in here.items()}
                pass_ = _linkable(q["n"], q["pos"], bn, bp)
                if not pass_.any():
                    continue
                at = _spread(first[pass_], count[pass_])
                at = at[e["label"][at] != q["label"]]
                at = at[(e["hub"][at] != q["hub"]) | _derivable(q["n"], q["o"], e["n"][at], e["o"][at])]
                if len(at):
                    made.append((np.full(len(at), q["a"]).view(np.uint64), e["a"][at].view(np.uint64)))
                    size += len(at)
                if size > 1 << 18:
                    yield out()
                    made, size = [], 0
    if made:
        yield out()


def _members(k: int, seed: int, words: np.ndarray, common: np.ndarray, counts: np.ndarray, prefix_only: bool):
    """Rows (sig, n, tokens) of the distinct sets that the filter may hold: whole, or the 32-bit shingles of their prefixes."""
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")
    kind = np.int32 if prefix_only else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            ends = np.cumsum([0, *[len(s) for _, _, s in kept]])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([s for _, _, s in kept]).view(kind)))
            return pa.RecordBatch.from_arrays([pa.array(np.array([g for g, _, _ in kept], np.uint64).view(np.int64)), pa.array([n for _, n, _ in kept], pa.int64()), cells], names=["sig", "n", "tokens"])

        for _, _, s, sig in _sets(batches, k, seed):
            n = len(s)
            if not n or sig in seen or not in_bloom(words, np.array([sig], np.uint64))[0]:
                continue
            seen.add(sig)
            s = np.unique(_short(_ordered(s, common, rank)[: n - (SHARE * n + 99) // 100 + 1])) if prefix_only else s
            kept.append((sig, n, s))
            size += len(s)
            if size > 1 << 19:
                yield out()
                kept, size, seen = [], 0, set()
        if kept:
            yield out()

    return run


class _Sets:
    """What verification reads of the documents' sets, by signature."""

    def __init__(self, docs: DataFrame, k: int, seed: int, common: np.ndarray, counts: np.ndarray):
        self.docs, self.args, self.of_sets = docs.select("text"), (common, counts), (k, seed)

    def of(self, sigs: DataFrame, prefix_only: bool) -> DataFrame:
        """sig, n, tokens of the sets with one of sigs (s), and of a few more."""
        kind = "int" if prefix_only else "long"
        return self.docs.mapInArrow(trimmed(_members(*self.of_sets, bloom(sigs, "s"), *self.args, prefix_only)), f"sig long, n long, tokens array<{kind}>").dropDuplicates(["sig"])

    @staticmethod
    def joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def possible(self, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
        """Pairs whose prefixes share enough: what both prefixes don't show lies behind one of them, or agrees with another shingle of it in 32 bits."""
        shown = F.size(F.array_intersect("t_a", "t_b"))
        hidden = F.greatest(F.col("n_a") - F.size("t_a"), F.col("n_b") - F.size("t_b"))
        return self.joined(pairs, prefixes).filter((100 + SHARE) * (shown + hidden) >= SHARE * (F.col("n_a") + F.col("n_b"))).select(*pairs.columns)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, hub) with n_a, n_b, whether they link, by whole sets, and the shingles that only a or only b has where one is the other's hub."""
        both = self.joined(pairs, self.of(_both(pairs), False))
        shared = F.size(F.array_intersect("t_a", "t_b"))
        linked = (100 + SHARE) * shared >= SHARE * (F.col("n_a") + F.col("n_b"))
        return both.select("a", "b", "hub", "n_a", "n_b", linked.alias("linked"), F.expr("if(hub is null, null, array_except(t_a, t_b))").alias("only_a"), F.expr("if(hub is null, null, array_except(t_b, t_a))").alias("only_b"))


def _with_hubs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with hub: the one of both that is the other's hub, the set that is compared with most sets, if that is more than the other's own number."""
    one = lambda x, y: pairs.select(F.col(x).alias("sig"), F.col(y).alias("other"))
    both = one("a", "b").unionByName(one("b", "a"))
    degree = written(both.groupBy("sig").agg(F.count("*").alias("d")))
    rank = lambda c: F.struct("d", F.negative(c).alias("m"), F.col(c).alias("hub"))
    best = both.join(degree.withColumnRenamed("sig", "other"), "other").groupBy("sig").agg(F.max(rank("other")).alias("best"))
    best = best.join(degree, "sig").filter(F.col("best") > rank("sig")).select("sig", F.col("best.hub").alias("hub"))
    chosen = best.select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"), "hub")
    return pairs.join(chosen, ["a", "b"], "left")


def _answers(verified: DataFrame) -> DataFrame:
    """sig, hub, n, o, gone, extra: of each set that has a hub its answer with it.

    o is what it shares with the hub, gone what the hub alone has, extra what it has beside the hub.
    """
    first = F.col("hub") == F.col("b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    found = verified.filter("hub is not null").select(pick("a", "b").alias("sig"), "hub", pick("n_a", "n_b").alias("n"), pick("only_b", "only_a").alias("gone"), pick("only_a", "only_b").alias("extra"))
    return found.withColumn("o", (F.col("n") - F.size("extra")).cast("int"))


def _derived(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs with hub_a, hub_b and, where these agree, whether they link: derived from both sets' answers with the hub, by the shingles that differ."""
    side = lambda x: answers.select(*[F.col("sig").alias(x) if c == "sig" else F.col(c).alias(f"{c}_{x}") for c in answers.columns])
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    hub = F.col("o_a") + F.size("gone_a")
    shared = hub - F.size("gone_a") - F.size("gone_b") + F.size(F.array_intersect("gone_a", "gone_b")) + F.size(F.array_intersect("extra_a", "extra_b"))
    same = F.coalesce(F.col("hub_a") == F.col("hub_b"), F.lit(False))
    return both.select("a", "b", same.alias("same"), (same & ((100 + SHARE) * shared >= SHARE * (F.col("n_a") + F.col("n_b")))).alias("linked"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()


#: Partitions of the lists at most; a partition takes its buckets one after the other.
MOST = 20_000


def near_duplicates(docs: DataFrame, k: int = WORDS, seed: int = 0) -> DataFrame:
    """One row per document of docs (doc_id, text): doc_id, n_shingles, component_id.

    Sets with one signature by the seed are one set if their sizes and second signatures agree as well;
    where some don't, all begins anew by the next seed.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    census = written(docs.mapInArrow(trimmed(_census(k, seed)), "doc_id long, n long, sig long, check long, token long, count long"))
    unlike = census.filter("n is not null").groupBy("sig").agg(*(f("check").alias(a) for f, a in ((F.min, "a"), (F.max, "b"))), *(f("n").alias(a) for f, a in ((F.min, "c"), (F.max, "d"))))
    if not unlike.filter("a <> b or c <> d").isEmpty():
        return near_duplicates(docs, k, seed + 1)
    rows = census.filter("n is not null").select("doc_id", "n", "sig")
    often = census.filter("token is not null").groupBy("token").agg(F.sum("count").alias("count")).filter(f"count >= {COMMON_MIN}").orderBy(F.desc("count"), "token").limit(COMMON).toPandas()
    tokens, counts = often["token"].to_numpy(np.int64).view(np.uint64), often["count"].to_numpy(np.int64)
    order = np.argsort(tokens)
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(spark), int(total * (100 - SHARE) / 100) // BUCKET)
    lists = docs.select("text").mapInArrow(trimmed(_listed(k, seed, tokens[order], counts[order], buckets)), "bucket long, entries binary")
    found = written(lists.repartition(min(buckets, MOST), "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_candidates(_short(tokens[counts > HOT]))), _CANDIDATE))
    sets = _Sets(docs, k, seed, tokens[order], counts[order])
    pairs = written(found.filter("token is null").groupBy("a", "b").agg(F.max("n").alias("by_hub")))
    long_lists = found.filter("token is not null").select("a", "token", "n", "pos").distinct()
    prefixes = written(sets.of(_both(pairs).union(long_lists.select("a")).distinct(), True))
    pairs = written(sets.possible(pairs, prefixes))
    first = written(sets.verified(_with_hubs(pairs.filter("by_hub = 1").select("a", "b"))))
    answers = _answers(first)
    done, waiting = first.select("a", "b"), pairs.filter("by_hub = 0").select("a", "b")
    links = first.filter("linked").select("a", "b")
    labels = components(links)
    before, last = None, False
    for turn in itertools.count():
        split, work, n = _still_split(long_lists, labels)
        last = work <= WIDE * n or before is not None and work > 0.7 * before
        before = work
        more = _all_rest(split, answers).unionByName(_apart(waiting, labels)) if last else _hub_pairs(split, turn)
        more = written(more.distinct().join(done, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            done = done.unionByName(more)
            told = written(_derived(more, answers))
            untold = written(sets.possible(told.filter("not same").select("a", "b"), prefixes))
            links = links.unionByName(told.filter("linked").select("a", "b"))
            if not untold.isEmpty():
                links = links.unionByName(written(sets.verified(untold.withColumn("hub", F.lit(None).cast("long"))).filter("linked").select("a", "b")))
            labels = components(links)
        if last:
            break
    return _named(rows, labels)


def _still_split(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, int]:
    """The entries of lists that hold more than one label, with theirs; how many pairs of different labels they have; and their number."""
    known = written(_labelled(entries, "a", labels, "label"))
    sizes = known.groupBy("token", "label").agg(F.count("*").cast("double").alias("c"))
    sizes = written(sizes.groupBy("token").agg(F.sum("c").alias("m"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("work"), F.max(F.struct("c", "label"))["label"].alias("top")).filter("work > 0"))
    total = sizes.agg(F.sum("work").alias("work"), F.sum("m").alias("n")).first()
    return known.join(sizes.select("token", F.col("m").cast("long").alias("m"), "top"), "token"), total["work"] or 0, total["n"] or 0


def _labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    found = rows.join(labels.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left")
    return found.withColumn(name, F.coalesce(name, column))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different labels."""
    return _labelled(_labelled(pairs, "a", labels, "l_a"), "b", labels, "l_b").filter("l_a <> l_b").select("a", "b")


def _hub_pairs(split: DataFrame, turn: int) -> DataFrame:
    """Pairs of the entries of each list with a hub of its largest classes: linear in the entries.

    The classes are dealt over HUBS parts, and the largest of each part has a hub: at first the set with
    the smallest part of rarer shingles, later others by a hash.
    """
    key = (F.col("pos") / F.col("n")) if turn == 0 else F.xxhash64("a", F.lit(turn)).cast("double")
    part = F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(HUBS))
    classes = split.withColumn("part", part).groupBy("token", "part", "label").agg(F.count("*").alias("c"), F.min(F.struct(key.alias("key"), "a", "n", "pos")).alias("e"))
    hubs = classes.groupBy("token", "part").agg(F.max(F.struct("c", "label", "e")).alias("best"))
    hubs = hubs.select("token", F.col("best.label").alias("h_label"), F.col("best.e.a").alias("h"), F.col("best.e.n").alias("h_n"), F.col("best.e.pos").alias("h_pos"))
    both = split.join(hubs, "token").filter("label <> h_label")
    small = F.when(F.col("n") <= F.col("h_n"), F.col("pos")).otherwise(F.col("h_pos"))
    low, high = F.least("n", "h_n"), F.greatest("n", "h_n")
    both = both.filter((5 * low >= 4 * high) & (small <= low - F.expr("(8 * least(n, h_n) + 8) div 9")) & (F.least(F.col("n") - F.col("pos"), F.col("h_n") - F.col("h_pos")) >= F.expr("(4 * (n + h_n) + 8) div 9")))
    return both.select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b"))


def _all_rest(split: DataFrame, answers: DataFrame) -> DataFrame:
    """Every pair of different labels of each list that the bounds leave: what isn't in a list's largest class, against all.

    A list is dealt over parts of about PART entries; the probes go to each of them.
    """
    rows = split.join(answers.select(F.col("sig").alias("a"), "hub", "o"), "a", "left").withColumn("hub", F.coalesce("hub", "a")).withColumn("o", F.coalesce("o", "n"))
    parts = F.ceil(F.col("m") / PART).cast("int")
    names = [x.split()[0] for x in _REST.split(", ")]
    entries = rows.withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).withColumn("probe", F.lit(False))
    probes = rows.filter("label <> top").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("probe", F.lit(True))
    dealt = entries.select(*names).unionByName(probes.select(*names))
    return dealt.repartition(partitions(split.sparkSession), "token", "part").sortWithinPartitions("token", "part", "probe").mapInArrow(_rest, "a long, b long")


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; a set's result goes back to its documents in SALTS parts."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = rows.filter("n > 0").groupBy("sig", "salt").agg(F.min("doc_id").alias("least"))
    parts = written(parts.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    names = parts.groupBy("root").agg(F.min("least").alias("component_id"))
    parts = parts.join(names, "root").select("sig", "salt", "component_id")
    out = rows.join(parts, ["sig", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """docs' rows, all columns, of which in each component the one with the smallest doc_id stays.

    Rows that share that doc_id stay together, as does each row of an id that heads one component
    and lies in another as well.
    """
    kept = near_duplicates(docs, k).filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("k_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["k_id"]), "left_semi")


def op6_jaccard_join(spark, sf_dir) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
