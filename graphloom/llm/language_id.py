"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It reads every byte of a
text in both directions, over words and spaces alike, and labels every position with
probabilities of the languages; a document's are the mean over all positions of its whole text.
So that many positions are computed at once, a text is read in windows of BODY bytes. A window's
states are those of WARM further bytes of the text before it (behind it, in the other direction),
at which they start from zero, as they do at the text's ends.

Defined cases: text that is null or has no letter is `und` with score 0; a null lang is not
learned from; with no labelled row every document is `und`; repeated rows agree; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from graphloom.llm import _text
from graphloom.llm._shared import trimmed

BODY, WARM = 256, 24
HIDDEN = 16
#: The bounded sample that is learned from: so many labelled documents, and pieces of PIECE bytes of each, spread over its text.
TRAIN_DOCS, TRAIN_PIECES, PIECE = 1500, 12, 48
#: Windows that are read at once: what a step holds of so many lies in a core's cache.
WINDOWS = 512
#: Documents of which no language has this mean probability are rejected by the pipeline's stage.
MIN_SCORE = 0.3
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network(NamedTuple):
    """Gate tables of both directions by byte, recurrent weights, and the output layer."""

    x: np.ndarray  #: (2, 256, 3 * hidden)
    u: np.ndarray  #: (2, hidden, 3 * hidden)
    w: np.ndarray  #: (2 * hidden, languages)
    b: np.ndarray


def start(languages: int, hidden: int = HIDDEN, seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return Network(f(2, 256, 3 * hidden, scale=0.3), f(2, hidden, 3 * hidden, scale=hidden**-0.5), f(2 * hidden, languages, scale=(2 * hidden) ** -0.5), np.zeros(languages, np.float32))


def _scan(net: Network, d: int, bytes_: np.ndarray, on: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, batch, hidden) of direction d; where `on` is false the state stays as it was."""
    n, t = bytes_.shape
    h = net.u.shape[1]
    state, out = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32)
    for i in range(t) if d == 0 else range(t - 1, -1, -1):
        x, rec = net.x[d][bytes_[:, i]], state @ net.u[d]
        z, r = _sigmoid(x[:, :h] + rec[:, :h]), _sigmoid(x[:, h : 2 * h] + rec[:, h : 2 * h])
        c = np.tanh(x[:, 2 * h :] + r * rec[:, 2 * h :])
        m = on[:, i, None]
        new = np.where(m, c + z * (state - c), state)
        if keep is not None:
            keep.append((i, state, z, r, c, rec[:, 2 * h :], m))
        state = out[i] = new
    return out


def gradients(net: Network, bytes_: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, Network]:
    """Mean cross entropy of all positions, and its gradient by backpropagation through time."""
    n, t = bytes_.shape
    h = net.u.shape[1]
    on = np.arange(t) < length[:, None]
    kept: tuple[list, list] = ([], [])
    states = np.concatenate([_scan(net, d, bytes_, on, kept[d]) for d in (0, 1)], 2)
    score = states @ net.w + net.b
    score -= score.max(2, keepdims=True)
    p = np.exp(score)
    p /= p.sum(2, keepdims=True)
    mask, total = on.T[:, :, None].astype(np.float32), on.sum()
    loss = -float((np.log(np.maximum(p[:, np.arange(n), label], 1e-9)) * mask[:, :, 0]).sum() / total)
    p[:, np.arange(n), label] -= 1
    p *= mask / np.float32(total)
    flat = p.reshape(t * n, -1)
    g = Network(np.zeros_like(net.x), np.zeros_like(net.u), states.reshape(t * n, -1).T @ flat, flat.sum(0))
    into = p @ net.w.T
    for d in (0, 1):
        back = np.zeros((n, h), np.float32)
        gates = np.zeros((t, n, 3 * h), np.float32)
        for i, state, z, r, c, rec, m in reversed(kept[d]):
            dh = into[i][:, d * h : (d + 1) * h] + back
            new = np.where(m, dh, 0)
            dz = new * (state - c) * z * (1 - z)
            dc = new * (1 - z) * (1 - c * c)
            dr = dc * rec * r * (1 - r)
            gates[i] = np.concatenate([dz, dr, dc], 1)
            up = np.concatenate([dz, dr, dc * r], 1)
            g.u[d] += state.T @ up
            back = np.where(m, new * z, dh) + up @ net.u[d].T
        order = bytes_.T.reshape(-1)
        for k in range(3 * h):
            g.x[d][:, k] = np.bincount(order, gates[:, :, k].reshape(-1), 256)
    return loss, g


def train(pieces: list[bytes], labels: np.ndarray, languages: int, steps: int = 180, batch: int = 384, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on batches of pieces of text."""
    net, r = start(languages, seed=seed), np.random.default_rng(seed)
    m, v = [np.zeros_like(x) for x in net], [np.zeros_like(x) for x in net]
    size = np.array([len(x) for x in pieces])
    for step in range(1, steps + 1 if len(pieces) else 1):
        at = r.integers(len(pieces), size=min(batch, len(pieces)))
        rows = np.full((len(at), int(size[at].max())), 32, np.uint8)
        rows[np.arange(rows.shape[1]) < size[at][:, None]] = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8)
        _, g = gradients(net, rows, size[at], labels[at])
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, (w, d) in enumerate(zip(net, g)):
            m[i] += 0.1 * (d - m[i])
            v[i] += 0.001 * (d * d - v[i])
            w -= (pace * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _read(net: Network, d: int, data: np.ndarray, place: np.ndarray, on: np.ndarray, score: np.ndarray) -> None:
    """Direction d over places (time, windows) of data: adds the last steps' part of the label scores (time, languages, windows).

    Where `on` is false the state is zero. Windows lie side by side, so that every gate is one run of memory. Gates' inputs are
    halved beforehand, as sigmoid(x) is (1 + tanh(x / 2)) / 2, and so is what the second gate is multiplied with.
    """
    h, skip = net.u.shape[1], len(place) - len(score)
    x_all = np.concatenate([0.5 * net.x[d][:, : 2 * h], net.x[d][:, 2 * h :]], 1)
    # one product a step: the gates' and new state's parts, and the labels' of the step before
    u = np.ascontiguousarray(np.concatenate([0.5 * net.u[d], net.w[d * h : (d + 1) * h]], 1).T)
    state = np.zeros((h, place.shape[1]), net.x.dtype)
    all_, byte_x = np.empty((len(u), state.shape[1]), net.x.dtype), np.empty((state.shape[1], 3 * h), net.x.dtype)
    x = np.empty((3 * h, state.shape[1]), net.x.dtype)
    z, r, gates, new = x[:h], x[h : 2 * h], x[: 2 * h], x[2 * h :]
    for i in range(len(place)):
        np.matmul(u, state, out=all_)
        if i > skip:
            score[i - 1 - skip] += all_[3 * h :]
        np.take(x_all, data[place[i]], axis=0, out=byte_x, mode="clip")
        x[:] = byte_x.T
        gates += all_[: 2 * h]
        np.tanh(gates, out=gates)
        gates += 1
        r *= all_[2 * h : 3 * h]
        new += r
        np.tanh(new, out=new)
        state -= new
        state *= z
        state *= 0.5
        state += new
        if not on[i].all():
            state *= on[i]
    if len(score):
        score[-1] += u[3 * h :] @ state


def label_windows(net: Network, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For windows that begin at start, in texts at [lo, hi) of data: the sum of the label probabilities of their BODY or fewer positions."""
    end = np.minimum(start + BODY, hi)
    wide, last = int((end - start).max()), len(data) - 1
    score = np.zeros((wide, net.b.size, len(start)), net.x.dtype)
    lo, hi, start = (x.astype(np.int32) for x in (lo, hi, start))  # within a stretch
    place = np.arange(-WARM, wide, dtype=np.int32)[:, None] + start
    _read(net, 0, data, np.clip(place, 0, last), (place >= lo) & (place < hi), score)
    place = np.arange(wide + WARM - 1, -1, -1, dtype=np.int32)[:, None] + start
    _read(net, 1, data, np.clip(place, 0, last), place < hi, score[::-1])
    score += net.b[:, None]
    score -= score.max(1, keepdims=True)
    np.exp(score, out=score)
    total = score.sum(1)
    inside = np.arange(wide)[:, None] < end - start
    weight = np.where(inside, 1 / total, np.float32(0))
    return np.stack([(score[:, k] * weight).sum(0, dtype=np.float64) for k in range(net.b.size)], 1)


def pooled(net: Network, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, languages): mean probabilities over all positions; zero rows for empty texts."""
    size = np.diff(off)
    count = -(-size // BODY)
    of = np.repeat(np.arange(len(size)), count)
    start = off[of] + BODY * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    out = np.zeros((len(size), net.b.size))
    order = np.argsort(np.minimum(off[of + 1] - start, BODY), kind="stable")
    for i in range(0, len(order), WINDOWS):
        at = order[i : i + WINDOWS]
        got = label_windows(net, data, off[of[at]], off[of[at] + 1], start[at])
        for k in range(net.b.size):
            out[:, k] += np.bincount(of[at], got[:, k], len(size))
    return out / np.maximum(size, 1)[:, None]


#: Bytes of text that are read together.
STRETCH = 4 << 20


def _identify(net: Network, names: list[str]):
    labels = np.array([*names, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            off, data = _text.buffers(column)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + STRETCH, "right")) - 1)
                hi = min(hi, batch.num_rows)
                p = pooled(net, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                letters = pc.match_substring_regex(column.slice(lo, hi - lo), r"\p{L}").to_numpy(zero_copy_only=False)
                best = np.where(letters & (p.sum(1) > 0), p.argmax(1) if len(names) else 0, len(names))
                score = np.where(best < len(names), np.round(p.max(1) if len(names) else 0, 4), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(labels[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])
                lo = hi

    return run


def _sample_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out, labels = batch.column("lang").to_pylist(), [], []
        off, data = _text.buffers(batch.column("text"))
        for row, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            n = min(TRAIN_PIECES, -(-(b - a) // PIECE))
            for k in range(n):
                at = a + (b - a) * k // n
                out.append(data[at : min(at + PIECE, b)].tobytes())
                labels.append(langs[row])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(labels, pa.string())], names=["piece", "lang"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[Network, list[str]]:
    """A network from at most train_docs labelled rows (doc_id, text, lang), those with the smallest hashes, and TRAIN_PIECES pieces of each."""
    key = F.xxhash64("doc_id")
    chosen = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang").orderBy(key, "doc_id").limit(train_docs).select("doc_id")
    sample = docs.filter("lang is not null").join(F.broadcast(chosen.distinct()), "doc_id").select("text", "lang").mapInArrow(_sample_pieces, "piece binary, lang string").toPandas()
    sample = sample.sort_values(["lang", "piece"]).reset_index(drop=True)
    names = sorted(sample["lang"].unique(), key=lambda x: x.encode())
    labels = np.searchsorted(np.array(names, object), sample["lang"].to_numpy(object)).astype(np.int64) if names else np.zeros(0, np.int64)
    return train(list(map(bytes, sample["piece"])), labels, max(1, len(names))), names


def identify(docs: DataFrame, net: Network, names: list[str]) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(trimmed(_identify(net, names)), "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame, mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(True))


def op7_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net, names = fit(docs.filter(~held_out(docs, 3, 1)))
    found = identify(docs, net, names)
    return found.select("doc_id", held_out(found, 3, 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs' rows, all columns, whose language is told with a score of min_score, with that language as lang.

    Where no row has a label nothing can be learned: rows with a letter stay as they are.
    """
    net, names = fit(docs.filter(~held_out(docs, 3, 1)))
    wide = [f.name for f in docs.schema]
    rows = docs.select(F.struct(*[docs[c] for c in wide]).alias("doc"))
    kept = rows.mapInArrow(trimmed(_flag(net, names, min_score)), StructType([*rows.schema.fields]).add("lang_pred", StringType()))
    return kept.select(*[F.col("lang_pred").alias(c) if c == "lang" and names else F.col("doc").getField(c).alias(c) for c in wide])


def _flag(net: Network, names: list[str], min_score: float):
    one = _identify(net, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc")
            texts = docs.field("text")
            ids = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), texts], names=["doc_id", "text"])
            at = 0
            for got in one(iter([ids])):
                text = pc.fill_null(texts.slice(at, got.num_rows), "")
                keep = pc.greater_equal(got.column("score"), max(min_score, 1e-9)) if names else pc.match_substring_regex(text, r"\p{L}")
                part = pa.RecordBatch.from_arrays([docs.slice(at, got.num_rows), got.column("lang_pred")], names=["doc", "lang_pred"])
                at += got.num_rows
                yield part.filter(keep)

    return run
