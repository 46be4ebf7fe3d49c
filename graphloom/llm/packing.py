"""Packing tokenised documents into sequences: the cutting-stock problem by column generation.

A document's ids are cut at every multiple of the capacity; the last pieces have all lengths. Their
histogram, in classes of GRAIN tokens, is the demand of a linear program whose columns are patterns
of classes that fit a sequence. A revised simplex method solves it; each further pattern is priced
by a knapsack dynamic program over the duals. The solution is rounded down, what is left over is
packed best fit decreasing, class by class, and pieces get their places by their rank among those
of their class. The driver handles the histogram and patterns alone, whose size the capacity bounds.

Defined cases: a null text is empty and has the end id alone; rows that repeat a doc_id are
documents of their own (their pieces get different places); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from graphloom.llm import _text
from graphloom.llm._shared import cut, partitions, trimmed

CAPACITY, GRAIN, END_ID = 2048, 16, 1
#: Ids of so many words are remembered by a worker, in about 40 bytes each.
MEMO = 500_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Table:
    """Ids by 64-bit key, in arrays: sorted keys, and where and how long their ids are. New keys wait in a small table."""

    def __init__(self, first_ids: np.ndarray):
        self.ids, self.used = np.append(first_ids, np.zeros(1 << 16, np.uint32)), len(first_ids)
        self.main = self.recent = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.main[0]) + len(self.recent[0])

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.recent = self._merged(self.recent, (keys, starts, sizes))
        if len(self.recent[0]) > 1 << 15:
            self.main, self.recent = self._merged(self.main, self.recent), tuple(x[:0] for x in self.recent)

    @staticmethod
    def _merged(x: tuple, y: tuple) -> tuple:
        both = [np.concatenate(c) for c in zip(x, y)]
        order = np.argsort(both[0], kind="stable")
        return tuple(c[order] for c in both)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes; a size of -1 for unknown keys."""
        starts, sizes = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        for known, at, n in (self.main, self.recent):
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                starts[hit], sizes[hit] = at[i[hit]], n[i[hit]]
        return starts, sizes


class WordIds:
    """Ids of texts by the tokenizer of word_bpe_49k.json, with memory of words.

    It never joins over ASCII white space, so a text's ids are those of its words. A word of ASCII
    letters, with a full stop or comma at most, is looked up lower-cased and without that; these
    are pieces of the tokenizer. Another word of plain Latin letters, digits and signs is
    lower-cased and split as the tokenizer does it. Unknown pieces are encoded together, since a
    piece's last id, and no other, ends a word. All other words are encoded one by one. Words are
    known by 64-bit hashes, and handled in arrays; Python sees unknown words of the second and
    third kind alone.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.comma, self.stop = self._encode([",", "."])
        self.table = self._empty()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # fixed values: the tokenizer's own pattern
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[!-~\u00A1-\u012F\u0131-\u024F]+").fullmatch

    def _empty(self) -> _Table:
        """A table that starts with the ids of a comma and of a full stop."""
        return _Table(np.concatenate([self.comma, self.stop]))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 512):
            part = pieces[i : i + 512]
            got = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(part):
                ids.append(got)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = self._encode(part)
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, simple: np.ndarray) -> None:
        """simple: spans that are pieces, once folded."""
        if simple.any():
            a, b = starts[simple], ends[simple]
            size = b - a + 1
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            raw = _text.FOLD[data[np.minimum(at, len(data) - 1)]]
            raw[np.cumsum(size) - 1] = 32
            self.table.add(keys[simple], *self._pieces(raw.tobytes().decode().split()))
        other = np.flatnonzero(~simple)
        if not len(other):
            return
        raw = data.tobytes()
        plain, odd = [], []
        for i, a, b in zip(other.tolist(), starts[other].tolist(), ends[other].tolist()):
            t = raw[a:b].decode()
            if self.plain(t) and "<|" not in t:
                plain.append((i, self.split(t.lower())))
            else:
                odd.append((i, t))
        if plain:
            ids, sizes = self._pieces([x for _, ps in plain for x in ps])
            first = np.cumsum([0, *(len(ps) for _, ps in plain)])
            ends_ = np.append(0, np.cumsum(sizes))
            self.table.add(keys[[i for i, _ in plain]], ids, np.diff(ends_[first]))
        if odd:
            each = self._encode([t for _, t in odd])
            self.table.add(keys[[i for i, _ in odd]], np.concatenate(each), np.array([len(x) for x in each], np.int64))

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts at off in data, and where each text's begin; memory is bounded for data of bounded size."""
        w = _text.words(data, off)
        n = len(w.starts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        signs = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_NO_LETTER[data], out=signs[1:])
        signs = signs[w.ends] - signs[w.starts]
        final = data[w.ends - 1]
        tail = (signs == 1) & ((final == 44) | (final == 46)) & (w.ends - w.starts > 1)
        simple = (signs == 0) | tail
        ends = w.ends - tail
        # words that aren't simple have keys of their own kind
        keys = np.where(simple, _text.span_hashes(data, w.starts, ends, True), _text.mix(w.hashes + np.uint64(0x9E3779B97F4A7C15)))
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        at, size = self.table.find(distinct)
        if (size < 0).any():
            if len(self.table) + len(distinct) > MEMO:
                self.table, size = self._empty(), np.full(len(distinct), -1)
            new = first[size < 0]
            self._learn(data, keys[new], w.starts[new], ends[new], simple[new])
            at, size = self.table.find(distinct)
        # items: a word's piece, and its full stop or comma after it
        place = np.arange(n) + np.cumsum(tail) - tail
        starts, sizes = np.zeros(n + int(tail.sum()), np.int64), np.zeros(n + int(tail.sum()), np.int64)
        starts[place], sizes[place] = at[of], size[of]
        comma = final[tail] == 44
        starts[place[tail] + 1] = np.where(comma, 0, len(self.comma))
        sizes[place[tail] + 1] = np.where(comma, len(self.comma), len(self.stop))
        begin = np.append(0, np.cumsum(sizes))
        ids = self.table.ids[np.repeat(starts - begin[:-1], sizes) + np.arange(begin[-1])]
        return ids, begin[np.append(place, len(starts))[w.first]]


_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123)]] = False


@lru_cache(1)
def _word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def token_ids(words: WordIds, column: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(row, little-endian 32-bit ids with the end id) of every text; a long text is read in stretches that end at white space."""
    end = np.array([END_ID], np.uint32)
    for lo, hi, data, off in _text.blocks(column):
        if hi - lo > 1 or len(data) <= 4 * _text.BLOCK:
            ids, begin = words.of(data, off)
            for k in range(hi - lo):
                yield lo + k, np.append(ids[begin[k] : begin[k + 1]], end).astype("<u4").tobytes()
            continue
        parts, a = [], 0
        while a < len(data):
            b = min(len(data), a + _text.BLOCK)
            while b < len(data) and not _text.IS_SPACE[data[b]]:
                gap = np.flatnonzero(_text.IS_SPACE[data[b : b + _text.BLOCK]])
                b = b + int(gap[0]) if len(gap) else min(len(data), b + _text.BLOCK)
            parts.append(words.of(data[a:b], np.array([0, b - a]))[0])
            a = b
        yield lo, np.concatenate([*parts, end]).astype("<u4").tobytes()


def _cut_up(path: str, capacity: int, with_ids: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for batch in batches:
            who, salt, rows, size = batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist(), [], 0
            for row, ids in token_ids(words, batch.column("text")):
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append((who[row], at, len(piece) // 4, zlib.crc32(piece), n, salt[row], *[piece] * with_ids))
                size += len(ids) if with_ids else 64
                if size > 1 << 22:
                    yield _piece_rows(rows, with_ids)
                    rows, size = [], 0
            if rows:
                yield _piece_rows(rows, with_ids)

    return run


def _piece_rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
    *numbers, last = zip(*rows) if with_ids else (*zip(*rows), None)
    columns = [pa.array(c, pa.int64()) for c in numbers]
    if with_ids:
        columns.append(pa.array([_packed(x) for x in last], pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _packed(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones where all fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else ids


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Binary ids as lists of numbers; a row's length tells how wide they are."""
    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        length, cells = batch.column("length").to_numpy(), batch.column("ids").to_pylist()
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.int32) for x, n in zip(cells, length.tolist())]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(np.concatenate(ids)))
        at = batch.schema.get_field_index("ids")
        yield batch.set_column(at, "ids", lists)


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within room: its value, and how often it holds each."""
    best, item = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        n = np.searchsorted(size, w, "right")
        best[w] = best[w - 1]
        if n:
            got = best[w - size[:n]] + value[:n]
            k = int(got.argmax())
            if got[k] > best[w] + 1e-12:
                best[w], item[w] = got[k], k
    counts, w = np.zeros(len(size)), room
    while w > 0:
        if item[w] < 0:
            w -= 1
        else:
            counts[item[w]] += 1
            w -= size[item[w]]
    return best[room], counts


def solve_patterns(size: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns by column, how often each): a basic solution of the linear program by column generation.

    size: item sizes, rising; the start is a pattern of each item alone. The basis' inverse is kept
    and updated by each pivot; the rounding checks every count, so that drift costs fill alone.
    """
    fits = room // size
    columns, inverse, x = np.diag(fits.astype(float)), np.diag(1.0 / fits), demand / fits
    for _ in range(rounds):
        dual = inverse.sum(0)
        worth, col = _knapsack(np.maximum(dual, 0), size, room)
        if worth <= 1 + 1e-7:
            break
        d = inverse @ col
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * d
        x[out] = ratio[out]
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        columns[:, out] = col
    return columns, np.maximum(x, 0)


def _best_fit(left: Counter, room: int) -> list[dict[int, int]]:
    """Sequences, as {class: count}, for the left-over counts: largest first, into the fullest that has room.

    Equal sequences are filled together, so the work grows with kinds of sequences, not with pieces.
    """
    done: list[dict[int, int]] = []
    by_gap: dict[int, list[dict[int, int]]] = {}
    for c in sorted(left, reverse=True):
        for _ in range(left[c]):
            gap = next((g for g in range(c, room + 1) if by_gap.get(g)), None)
            seq = by_gap[gap].pop() if gap is not None else {}
            if gap is None:
                done.append(seq)
            seq[c] = seq.get(c, 0) + 1
            by_gap.setdefault((room if gap is None else gap) - c, []).append(seq)
    return done


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple[int, int, int, int, int]]:
    """From counts of piece lengths: (class, first rank, end rank, pieces of it in one sequence, first sequence).

    Ranks of a class in [first, end) go to the sequences from `first sequence` on, so many to each.
    """
    room, classes = capacity // grain, Counter()
    for length, n in histogram.items():
        classes[-(-length // grain)] += n
    size = np.array(sorted(classes))
    if not len(size):
        return []
    demand = np.array([classes[c] for c in size], float)
    columns, x = solve_patterns(size, demand, room)
    left, kinds = Counter(classes), []
    for j in np.argsort(-x, kind="stable"):
        pattern = {int(size[i]): int(columns[i, j]) for i in np.flatnonzero(columns[:, j])}
        n = min([int(x[j] + 1e-9), *(left[c] // a for c, a in pattern.items())])
        if n > 0:
            kinds.append((pattern, n))
            left.subtract({c: a * n for c, a in pattern.items()})
    kinds += [(s, 1) for s in _best_fit(+left, room)]
    rows, rank, sequence = [], Counter(), 0
    for pattern, n in kinds:
        for c, a in pattern.items():
            rows.append((c, rank[c], rank[c] + a * n, a, sequence))
            rank[c] += a * n
        sequence += n
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Ranks within a class come from counts by (class, salt) and row numbers within such a part. Ids
    wait in the shared folder, in 16 bits each where they fit, until the places are known, and are
    shuffled once.
    """
    spark = docs.sparkSession
    salts = 4 * partitions(spark)
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    found = rows.mapInArrow(trimmed(_cut_up(path or tokenizer_path(), capacity, with_ids)), _PIECES + ", ids binary" * with_ids)
    found = cut(found.withColumn("piece", F.monotonically_increasing_id()))
    pieces = found.drop("ids").withColumn("class", F.ceil(F.col("length") / grain))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    schema = "class long, lo long, hi long, per long, first long"
    places = spark.createDataFrame(plan(histogram, capacity, grain), schema)
    parts = pieces.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.join(parts, ["class", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    put = ranked.join(F.broadcast(places), ["class"]).filter("rank >= lo and rank < hi")
    put = put.withColumn("sequence_id", F.expr("first + (rank - lo) div per")).withColumn("slot", F.expr("(rank - lo) % per"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset")]
    if not with_ids:
        return put.select(*names)
    out = put.select(*names, "piece").join(found.select("piece", "ids"), "piece").drop("piece")
    return out.mapInArrow(trimmed(_unpacked), StructType([*out.schema.fields[:-1], StructField("ids", ArrayType(IntegerType()))]))


def op5_packing(spark, sf_dir) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["CAPACITY", "op5_packing", "pack", "plan", "solve_patterns"]
