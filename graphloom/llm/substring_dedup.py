"""Repeated passages of words, found by compressed FM-indexes over shards of the corpus.

A window is WINDOW consecutive words. Equal windows have the same minimiser, the least of their
GRAM-word hashes, at the same place, so a corpus is sharded by minimisers: runs of windows with one
minimiser are cut out as a segment and sent to the shard that the minimiser names. Minimisers are
counted over the whole corpus first; segments whose minimiser occurs once stay where they are, and
frequent ones yield to any other in the window, so that a line that very many documents share
doesn't gather their text in one place. Equal segments are one where they are read.

A shard's segments are in order of document and place, and make blocks of about BLOCK words. Each
block in turn is an FM-index: the Burrows-Wheeler transform in a wavelet matrix of packed bits
with rank counts, how many symbols neighbouring suffixes share (WINDOW at most), and the earliest
place of each run of suffixes that share so many. The segments of that block and of all later ones
are streamed through it from their ends: each word is a step of the backward search; where the
interval becomes empty, it is widened to the longest shorter match that can go on. That gives each
place's matching statistic, cut off at WINDOW words. A window that reaches WINDOW in an earlier
block is removed, and one of the same block if the run's earliest place is before its own. A task
holds one index at a time, and a shard's distinct segments.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a null doc_id
counts as the largest; rows with one doc_id and different texts are ordered by a hash of the text,
rows that repeat both do not remove each other and come out alike; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _text
from graphloom.llm._shared import bloom, cut, in_bloom, partitions

WINDOW, GRAM = 20, 5
#: Minimisers that occur more often yield to others; so many are known to all workers.
FREQUENT, FREQUENT_KEPT = 500, 1 << 16
#: Words in a shard, on average, and in the part of it that one index is of.
SHARD, BLOCK = 400_000, 200_000
#: So many words of a shard are held before copies among its segments are put together.
HELD = 4_000_000
_U = np.uint64
_PLACE = _U((1 << 28) - 1)
_LAST = (1 << 63) - 1


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width`, a power of two."""
    step = 1
    while step < width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return v


def _minimisers(w: _text.Words, frequent: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hashes of the word runs, windows' minimiser places, places when the frequent yield, whether a window is in one text)."""
    h = w.hashes
    if len(h) < WINDOW:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(0, bool)
    g = _text.grams(h, GRAM)
    owner = np.repeat(np.arange(len(w.first) - 1, dtype=np.int32), np.diff(w.first))
    v = ((_text.mix(g + _U(0x632BE59BD9B4E019)) >> _U(29)) << _U(28)) | np.arange(len(g), dtype=np.uint64)
    width = WINDOW - GRAM + 1
    plain = (_sliding_min(v, width) & _PLACE).astype(np.int64)
    late = plain
    if frequent is not None and len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)] == g
        if often.any():
            late = (_sliding_min(v | (often.astype(np.uint64) << _U(63)), width) & _PLACE).astype(np.int64)
    return g, plain, late, owner[: len(h) - WINDOW + 1] == owner[WINDOW - 1 :]


def _census(batches: Iterator[pa.RecordBatch], chunk: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "count"])

    for batch in batches:
        for _, _, data, off in _text.blocks(batch.column("text")):
            g, place, _, inside = _minimisers(_text.words(data, off))
            if len(g):
                held.append(g[np.unique(place[inside])])
                size += len(held[-1])
            if size >= chunk:
                yield out()
                held, size = [], 0
    if size:
        yield out()


_SEGMENT = "bucket long, segments binary, doc_id long, version long, lo long, hi long"


def _known(bucket: np.ndarray, doc: np.ndarray, version: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(n, pa.binary()), *map(pa.array, (doc, version, lo, hi))], names=["bucket", "segments", "doc_id", "version", "lo", "hi"])


def _run_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of the runs of words from a to b."""
    n = len(hashes)
    p, q = (_text._P, _text._Q) if n <= _text.BLOCK else (_text._powers(_text._BASE, n), _text._powers(_text._INV, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * p[:n], out=sums[1:])
    return _text.mix((sums[b] - sums[a]) * q[a])


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs that start at begin."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _copies(key, size, doc, version, start, begin, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of segments by key, length and place; which of these are copies of the one at head, the earliest, word by word; and head."""
    order = np.lexsort((start, version, doc, size, key))
    again = np.append(False, (key[order][1:] == key[order][:-1]) & (size[order][1:] == size[order][:-1]))[: len(order)]
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    at = np.flatnonzero(again)
    if len(at):
        n = size[order[at]]
        equal = text[_spread(begin[order[at]], n)] == text[_spread(begin[order[head[at]]], n)]
        again[at] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return order, again, head


def _cut_out(words: np.ndarray, frequent: np.ndarray, shards: int, chunk: int = 1 << 20):
    """Rows (bucket, segments) of the runs of windows that may be repeated, and rows (doc_id, version, lo, hi) of those that are for certain."""

    def out(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        bucket, doc, version, start, size, key, text = (np.concatenate(x) for x in zip(*parts))
        begin = np.cumsum(size) - size
        order, again, head = _copies(key, size, doc, version, start, begin, text)
        # an equal place is the same row of a repeated document, which isn't earlier
        same = lambda c: c[order] == c[order[head]]
        later = order[again & ~(same(doc) & same(version) & same(start))]
        if len(later):
            # what is known already needs no shard, so it is dealt evenly
            anywhere = (_text.mix(doc[later].view(np.uint64) ^ (start[later].view(np.uint64) << _U(40))) % _U(shards)).astype(np.int64)
            yield _known(anywhere, doc[later], version[later], start[later], start[later] + size[later])
        kept = order[~again]
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        at = np.flatnonzero(np.append(True, bucket[kept][1:] != bucket[kept][:-1]))
        blobs = []
        for i, j in zip(at, np.append(at[1:], len(kept))):
            k = kept[i:j]
            blobs.append(b"".join(x.tobytes() for x in (np.array([len(k)], np.int64), doc[k], version[k], start[k], size[k], text[_spread(begin[k], size[k])])))
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[kept][at]), pa.array(blobs, pa.binary()), none, none, none, none], names=["bucket", "segments", "doc_id", "version", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
            for row, _, data, off in _text.blocks(batch.column("text")):
                w = _text.words(data, off)
                g, plain, late, inside = _minimisers(w, frequent)
                if not len(g):
                    continue
                able = np.zeros(len(g), bool)
                places = np.unique(plain[inside])
                able[places] = in_bloom(words, g[places])
                at = np.flatnonzero(inside & able[plain])
                if not len(at):
                    continue
                of = np.searchsorted(w.first, at, "right") - 1
                new = np.append(True, (at[1:] != at[:-1] + 1) | (late[at][1:] != late[at][:-1]) | (of[1:] != of[:-1]))
                a, b = at[new], at[np.append(new[1:], True)] + WINDOW
                of = of[new]
                key, size = _run_keys(w.hashes, a, b), b - a
                parts.append(((_text.mix(g[late[a]]) % _U(shards)).astype(np.int64), ids[row + of], versions[row + of], a - w.first[of], size, key, w.hashes[_spread(a, size)]))
                held += int(size.sum())
                if held >= chunk:
                    yield from out(parts)
                    parts, held = [], 0
        if parts:
            yield from out(parts)

    return run


class Bits:
    """Packed bits with the number of ones before every 64th."""

    def __init__(self, bit: np.ndarray):
        packed = np.zeros((len(bit) + 64) // 64 * 8, np.uint8)
        raw = np.packbits(bit, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.ones = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.ones[1:])

    def rank(self, end: np.ndarray) -> np.ndarray:
        """How many ones are before each end."""
        at = end >> 6
        return self.ones[at] + np.bitwise_count(self.words[at] & ((_U(1) << (end & 63).astype(np.uint64)) - _U(1)))


class WaveletMatrix:
    """Rank queries over a sequence of numbers under `symbols`: a row of bits a level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, self.zeros = [], []
        seq = sequence
        for level in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            self.levels.append((level, Bits(bit)))
            self.zeros.append(len(bit) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        every = np.arange(symbols)
        self.base = self._walk(every, np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        for (level, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(end)
            end = np.where((symbol >> level) & 1, zeros + ones, end - ones)
        return end

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        return self._walk(symbol, end) - self.base[symbol]


class FMIndex:
    """Of a text of symbols from 1 on, in which 0 ends each segment, for matches of `depth` symbols at most.

    Suffixes are sorted by prefix doubling, as far as is needed to tell `depth` symbols apart; what
    stays is the wavelet matrix, a byte a suffix for what it shares with the one before, and for each
    run of suffixes that share `depth` symbols the earliest place.
    """

    def __init__(self, text: np.ndarray, depth: int = WINDOW):
        n, self.depth, self.symbols = len(text), depth, int(text.max()) + 1
        rank, width, order = text, 1, np.argsort(text, kind="stable")
        while width < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            step = np.append(0, (key[order][1:] != key[order][:-1]).astype(np.int64))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            width *= 2
        self.size = n
        self.starts = np.append(0, np.cumsum(np.bincount(text, minlength=self.symbols)))
        self.wavelet = WaveletMatrix(text[order - 1], self.symbols)
        self.shared = np.zeros(n + 1, np.uint8)
        same = np.arange(1, n)
        for k in range(depth):
            x, y = order[same] + k, order[same - 1] + k
            same = same[(np.maximum(x, y) < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])]
            self.shared[same] = k + 1
        self._runs: dict[int, tuple[Bits, np.ndarray]] = {}
        self.earliest = np.minimum.reduceat(order, self._run(depth)[1][:-1])

    def _run(self, k: int) -> tuple[Bits, np.ndarray]:
        """Of the runs of suffixes that share k symbols: a bit at each first row, and these rows, with the end behind."""
        if k not in self._runs:
            first = self.shared[:-1] < k
            first[0] = True
            self._runs[k] = Bits(first), np.append(np.flatnonzero(first), self.size).astype(np.int32)
        return self._runs[k]

    def _widened(self, lo: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first k symbols of the suffixes at rows lo."""
        a, b = np.zeros_like(lo), np.full_like(lo, self.size)
        for depth in np.unique(k[k > 0]):
            at = np.flatnonzero(k == depth)
            bits, rows = self._run(int(depth))
            run = bits.rank(lo[at] + 1) - 1
            a[at], b[at] = rows[run], rows[run + 1]
        return a, b

    def _step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.tile(self.starts[c], 2)
        return found[: len(c)], found[len(c) :]

    def statistics(self, query: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every place of query, `depth` at most: how many symbols from there on, in the segment, occur in the text; and the earliest place where `depth` do.

        query has the text's symbols, and 0 for any other; segments of the given sizes stop at ends.
        """
        length, place = np.zeros(len(query), np.int64), np.full(len(query), self.size)
        low, high, depth = np.zeros(len(ends), np.int64), np.full(len(ends), self.size), np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for step in range(int(sizes.max()) if len(sizes) else 0):
            live = live[sizes[live] > step]
            at = ends[live] - 1 - step
            c = query[at]
            lo, hi, d = low[live], high[live], depth[live]
            lo[c == 0], hi[c == 0], d[c == 0] = 0, self.size, 0
            x, y = lo.copy(), hi.copy()
            todo = np.flatnonzero(c)
            while len(todo):
                x[todo], y[todo] = self._step(c[todo], lo[todo], hi[todo])
                todo = todo[x[todo] >= y[todo]]
                d[todo] = np.maximum(self.shared[lo[todo]], self.shared[hi[todo]])
                lo[todo], hi[todo] = self._widened(lo[todo], d[todo])
            d[c > 0] += 1
            over = np.flatnonzero(d >= self.depth)
            if len(over):
                d[over] = self.depth
                bits, rows = self._run(self.depth)
                run = bits.rank(x[over] + 1) - 1
                x[over], y[over] = rows[run], rows[run + 1]
                place[at[over]] = self.earliest[run]
            length[at] = d
            low[live], high[live], depth[live] = x, y, d
        return length, place


def _laid_out(words: np.ndarray, begin: np.ndarray, size: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments one after another, each with 0 behind, as numbers from 1 on of the known words, 0 for others; and the segments' ends."""
    ends = np.cumsum(size + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    w = words[_spread(begin, size)]
    at = np.minimum(np.searchsorted(known, w), len(known) - 1)
    text[inside] = np.where(known[at] == w, at + 1, 0)
    return text, ends


class _Shard:
    """The distinct segments of a shard, with the spans that are known to be copies."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held, self.room = 0, HELD

    def add(self, blob: bytes) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(blob, np.int64)
        m = int(raw[0])
        self.parts.append((*(raw[1 + k * m : 1 + (k + 1) * m] for k in range(4)), raw[1 + 4 * m :].view(np.uint64)))
        self.held += len(raw)
        if self.held > self.room:
            yield from self._put_together()
            self.room = max(HELD, 2 * self.held)

    def _put_together(self) -> Iterator[pa.RecordBatch]:
        """Segments in order of document and place, once each; later copies come out as spans."""
        doc, version, start, size, words = (np.concatenate(c) for c in zip(*self.parts))
        begin = np.cumsum(size) - size
        order, again, head = _copies(_run_keys(words, begin, begin + size), size, doc, version, start, begin, words)
        same = lambda c: c[order] == c[order[head]]
        # a repeated row's segments are at one place, which is listed once
        later = order[again & ~(same(doc) & same(version) & same(start))]
        if len(later):
            yield _spans(doc[later], version[later], start[later], start[later] + size[later])
        kept = order[~again]
        kept = kept[np.lexsort((start[kept], version[kept], doc[kept]))]
        self.parts = [(doc[kept], version[kept], start[kept], size[kept], words[_spread(begin[kept], size[kept])])]
        self.held = len(self.parts[0][4])

    def spans(self) -> Iterator[pa.RecordBatch]:
        """The intervals of words that repeated windows cover."""
        yield from self._put_together()
        doc, version, start, size, words = self.parts[0]
        begin = np.cumsum(size) - size
        cut_at = np.flatnonzero(np.diff(begin // BLOCK, prepend=-1))
        blocks = [slice(i, j) for i, j in zip(cut_at, [*cut_at[1:], len(size)])]
        repeated = [np.zeros(int(size[b].sum()) + b.stop - b.start, bool) for b in blocks]
        for i, b in enumerate(blocks):
            known = np.unique(words[begin[b.start] : begin[b.stop - 1] + size[b.stop - 1]])
            text, _ = _laid_out(words, begin[b], size[b], known)
            index = FMIndex(text)
            for j in range(i, len(blocks)):
                query, ends = _laid_out(words, begin[blocks[j]], size[blocks[j]], known)
                length, place = index.statistics(query, ends, size[blocks[j]])
                repeated[j] |= (length >= WINDOW) & (place < np.arange(len(query)) if i == j else True)
        for b, hit in zip(blocks, repeated):
            at, ends = np.flatnonzero(hit), np.cumsum(size[b] + 1) - 1
            if not len(at):
                continue
            of = np.searchsorted(ends, at, "right")
            new = np.append(True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]))
            lo, hi, of = at[new], at[np.append(new[1:], True)], of[new]
            base = ends[of] - size[b][of]
            yield _spans(doc[b][of], version[b][of], start[b][of] + lo - base, start[b][of] + hi - base + WINDOW)


def _spans(doc: np.ndarray, version: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, version, lo, hi)], names=["doc_id", "version", "lo", "hi"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, shard = None, None
    for batch in batches:
        known = batch.filter(batch.column("segments").is_null())
        if known.num_rows:
            yield known.select(["doc_id", "version", "lo", "hi"])
        blobs = batch.column("segments")
        for i, x in enumerate(batch.column("bucket").to_pylist()):
            if not blobs[i].is_valid:
                continue
            if x != bucket and shard is not None:
                yield from shard.spans()
                shard = None
            bucket, shard = x, shard or _Shard()
            yield from shard.add(blobs[i].as_py())
    if shard is not None:
        yield from shard.spans()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, version, lo, hi: word intervals of docs (doc_id, version, text) that windows which also start earlier cover; they may overlap."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_census, "h long, count long").groupBy("h").agg(F.sum("count").alias("count")).filter("count > 1")
    counts = cut(counts)
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.filter(f"count > {FREQUENT}").orderBy(F.desc("count"), "h").limit(FREQUENT_KEPT).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    shards = max(partitions(spark), int(total * 28) // SHARD)
    segments = docs.mapInArrow(_cut_out(bloom(counts, "h"), np.sort(often), shards), _SEGMENT)
    return segments.repartition(shards, "bucket").sortWithinPartitions("bucket").mapInArrow(_search, "doc_id long, version long, lo long, hi long")


def _kept_words(text: bytes, spans: bytes | None) -> tuple[int, list[bytes]]:
    words = text.split()
    if not spans:
        return len(words), words
    cover = np.zeros(len(words) + 1, np.int32)
    lo_hi = np.frombuffer(spans, "<i8").reshape(-1, 2)
    np.add.at(cover, lo_hi[:, 0], 1)
    np.add.at(cover, lo_hi[:, 1], -1)
    keep = np.cumsum(cover[:-1]) == 0
    return len(words), [words[i] for i in np.flatnonzero(keep)]


def _rest(with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for text, spans in zip(part.column("text"), part.column("spans")):
                    s = [(x["lo"], x["hi"]) for x in spans.as_py()] if spans.is_valid else []
                    n, kept = _kept_words((text.as_py() or "").encode(), np.array(s, "<i8").tobytes())
                    whole = b" ".join(kept)
                    rows.append((n, n - len(kept), hashlib.sha256(whole).hexdigest(), *[whole.decode()] * with_text))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, zip(*rows))], names=names)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("key"), F.xxhash64("text").alias("version"), "text")
    spans = repeated_spans(rows.select(F.col("key").alias("doc_id"), "version", "text"))
    spans = spans.groupBy(F.col("doc_id").alias("key"), "version").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.join(spans, ["key", "version"], "left").select("doc_id", "text", "spans").mapInArrow(_rest(with_text), kind)


def op10_substring_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
