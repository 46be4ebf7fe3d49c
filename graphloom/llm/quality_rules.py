"""Quality rules: a log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials are counted over
every document: the raw corpus, and the trusted target (documents that `labels` marks quality 1).
A document's score is the mean, over its n-grams, of log p_target - log p_raw, with additive
smoothing. The threshold lies SIGMAS standard deviations under the target's mean score; scores and
their sums are whole micro-units, so that reruns agree to the row.

Defined cases: a null text has no words; a document without n-grams scores 0; with no trusted
document at all every score is 0 and the base rules alone decide; repeated rows are scored alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _text
from graphloom.llm._shared import cut

BUCKETS = 1 << 16
SMOOTHING = 1.0
SIGMAS = 4.0
#: Trusted ids are broadcast up to this many (12 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: A text over this many bytes has its lines compared one by one.
_LONG = 4 * _text.BLOCK

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal among the keys, has an equal that comes earlier)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def base_counts(data: np.ndarray, off: np.ndarray, w: _text.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a block's texts."""
    n = len(off) - 1
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(n), counts)
    salt = _text.mix(np.arange(1, n + 1, dtype=np.uint64))
    out = {"n_words": counts, "word_chars": _per_text(~_text.IS_SPACE[data] & ((data & 0xC0) != 0x80), off), "n_symbols": _per_text(_SYMBOL[data], off)}
    if len(data) > _LONG:
        lines = [x for x in bytes(data).split(b"\n") if x.split()]
        out["n_dup_lines"] = np.array([len(lines) - len(set(lines))])
    else:
        feed = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], feed + 1]))
        starts = starts[starts < len(data)]
        of = np.searchsorted(off, starts, "right") - 1
        ends = np.minimum(np.append(feed, len(data))[np.searchsorted(feed, starts)], off[of + 1])
        full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends, of = starts[full], ends[full], of[full]
        _, later = _repeats(_text.span_hashes(data, starts, ends) ^ salt[of])
        out["n_dup_lines"] = np.bincount(of[later], minlength=n)
    g = _text.grams(w.hashes, 3)
    cover = np.zeros(len(owner), bool)
    if len(g):
        inside = owner[: len(g)] == owner[2:]
        at = np.flatnonzero(inside)
        twice, _ = _repeats(g[at] ^ salt[owner[at]])
        for i in range(3):
            cover[at[twice] + i] = True
    out["n_repeat_words"] = np.bincount(owner[cover], minlength=n)
    return out


def _ngrams(w: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the block's words and word pairs, and the text of each."""
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    two = _text.grams(w.hashes, 2)
    inside = owner[: len(two)] == owner[1:] if len(two) else np.zeros(0, bool)
    keys = np.concatenate([w.hashes, two[inside]])
    return (keys >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), np.concatenate([owner, owner[: len(two)][inside]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = np.asarray(batch.column("trusted").to_numpy(zero_copy_only=False), bool)
        for lo, hi, data, off in _text.blocks(batch.column("text")):
            key, of = _ngrams(_text.words(data, off))
            raw += np.bincount(key, minlength=BUCKETS)
            target += np.bincount(key[trusted[lo:hi][of]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def _score(ratio: np.ndarray):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score_micro", "trusted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in _text.blocks(batch.column("text")):
                w = _text.words(data, off)
                base = base_counts(data, off, w)
                key, of = _ngrams(w)
                n = np.bincount(of, minlength=hi - lo)
                score = np.rint(1e6 * np.bincount(of, ratio[key], hi - lo) / np.maximum(n, 1)).astype(np.int64)
                cols = [batch.column("doc_id").slice(lo, hi - lo), *[pa.array(base[c].astype(np.int64)) for c in names[1:6]], pa.array(score), batch.column("trusted").slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def quality_rules(docs: DataFrame, trusted: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """One row per document (doc_id, text): the base counts, base_failed, score, threshold, kept.

    trusted: doc_id of the target's documents. What comes to the driver is BUCKETS pairs of counts.
    """
    ids = trusted.select("doc_id").filter("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    small = ids.count() <= BROADCAST_IDS
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = rows.select("text", "trusted").mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    p = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    ratio = p(target) - p(raw) if target.sum() else np.zeros(BUCKETS)
    kind = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score_micro long, trusted boolean"
    scored = cut(rows.mapInArrow(_score(ratio), kind))
    s = scored.filter("trusted and n_words > 0").agg(F.count("*").alias("n"), F.sum(F.col("score_micro").cast("decimal(38,0)")).alias("a"), F.sum(F.expr("cast(score_micro as decimal(18,0)) * score_micro")).alias("b")).first()
    mean = float(s["a"]) / s["n"] if s["n"] else 0.0
    threshold = math.floor(mean - sigmas * math.sqrt(max(float(s["b"]) / s["n"] - mean * mean, 0.0))) if s["n"] else -(1 << 62)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score_micro") >= threshold)).alias("kept"), (F.col("score_micro") / 1e6).alias("score"), F.lit(threshold / 1e6).alias("threshold"))


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted)
