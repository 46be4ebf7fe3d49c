"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts its digests into a run and merges equal neighbours. Then runs are exchanged
in rounds: in round r the FAN runs whose numbers differ in digit r alone cut themselves up by digit
r of the digest, pieces stay sorted, and each run merges the FAN sorted pieces that it gets,
retaining the smallest identifier and the count of each digest. After log_FAN(runs) rounds every
digest is in the one run that its digits name. A group of copies of any size is one entry a run and
round. Equal neighbours are verified by the whole 256-bit digest and the length at every level. Runs
travel as arrays; a task holds the pieces of its runs, 56 bytes a distinct digest.

Defined cases: a null text counts as empty; texts that differ only in runs of white space are
equal; a null doc_id counts as the largest; of rows that repeat both doc_id and text exactly one
stays; an empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import SPACE, cut, partitions

FAN = 8
#: A group's rows are joined with its result in so many parts.
SALTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


_LAST = (1 << 63) - 1  #: stands for a null doc_id
_WIDTH = 7  #: rows of a run: the digest's four words, n_bytes, keep_id, group_size


def merge(pieces: list[np.ndarray]) -> np.ndarray:
    """One sorted run of sorted pieces (_WIDTH, n); equal digests become one entry.

    The stable sort by the digests' first words finds the pieces' order and merges them; what ties there
    and isn't equal is put in order by the rest.
    """
    e = np.concatenate(pieces, 1)
    e = e[:, np.argsort(e[0], kind="stable")]
    tie, differ = e[0, 1:] == e[0, :-1], (e[1:5, 1:] != e[1:5, :-1]).any(0)
    if (tie & differ).any():
        e = e[:, np.lexsort(e[4::-1])]
        tie, differ = e[0, 1:] == e[0, :-1], (e[1:5, 1:] != e[1:5, :-1]).any(0)
    at = np.flatnonzero(np.append(True, ~tie | differ))[: e.shape[1]]
    if len(at) < e.shape[1]:
        ids = np.minimum.reduceat(e[5].view(np.int64), at)
        counts = np.add.reduceat(e[6], at)
        e = e[:, at]
        e[5], e[6] = ids.view(np.uint64), counts
    return e


_RUN = "run int, piece binary"


def _dealt(run: int, e: np.ndarray, r: int) -> Iterator[pa.RecordBatch]:
    """A run's pieces for round r, each under the run that it goes to."""
    bits = FAN.bit_length() - 1
    digit = (e[0] >> np.uint64(64 - bits * (r + 1))) & np.uint64(FAN - 1)
    base = run - run // FAN**r % FAN * FAN**r
    for d in range(FAN):
        piece = e[:, digit == d]
        if piece.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array([base + d * FAN**r], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["run", "piece"])


def _first_runs(runs: int, chunk: int = 1 << 17):
    """Each partition's digests as a sorted run, cut up for the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_, fresh, size = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            e = np.empty((_WIDTH, batch.num_rows), np.uint64)
            e[:4] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4).T
            e[4] = batch.column("n_bytes").to_numpy().view(np.uint64)
            e[5] = batch.column("keep_id").to_numpy().view(np.uint64)
            e[6] = 1
            fresh.append(e)
            size += batch.num_rows
            if size > chunk:
                sorted_.append(merge(fresh))
                fresh, size = [], 0
        pieces = [*sorted_, *([merge(fresh)] if fresh else [])]
        if pieces:
            yield from _dealt(TaskContext.get().partitionId() % runs, merge(pieces), 0)

    return run


def _merge_round(r: int, rounds: int):
    """Merges the pieces of each run, and cuts the run up for round r, or gives its entries out after the last."""

    def out(run: int, pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = merge([np.frombuffer(x, np.uint64).reshape(_WIDTH, -1) for x in pieces])
        if r < rounds:
            yield from _dealt(run, e, r)
            return
        for i in range(0, e.shape[1], 1 << 16):
            part = e[:, i : i + (1 << 16)]
            raw = part[:4].T.astype(">u8").tobytes()
            digests = pa.Array.from_buffers(pa.binary(32), part.shape[1], [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([digests, *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in part[4:])], names=["digest", "n_bytes", "keep_id", "group_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            pieces = batch.column("piece")
            for i, name in enumerate(batch.column("run").to_pylist()):
                if name != now and held:
                    yield from out(now, held)
                    held = []
                now = name
                held.append(pieces[i].as_py())
        if held:
            yield from out(now, held)

    return run


def tree_merge(digests: DataFrame) -> DataFrame:
    """digest, n_bytes, keep_id, group_size of the distinct digests of rows (doc_id, digest, n_bytes)."""
    n = partitions(digests.sparkSession)
    rounds = max(1, math.ceil(math.log(n, FAN)))
    rows = digests.select("digest", "n_bytes", F.coalesce("doc_id", F.lit(_LAST)).alias("keep_id"))
    runs = rows.mapInArrow(_first_runs(FAN**rounds), _RUN)
    for r in range(1, rounds + 1):
        kind = _RUN if r < rounds else "digest binary, n_bytes long, keep_id long, group_size long"
        runs = runs.repartition(n, "run").sortWithinPartitions("run").mapInArrow(_merge_round(r, rounds), kind)
    return runs


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    The result of a large group goes back to its rows in SALTS parts of the identifiers.
    """
    text = F.encode(normalised(F.col("text")), "UTF-8")
    found = cut(docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    groups = cut(tree_merge(found.select("doc_id", "digest", "n_bytes")).filter("group_size > 1"))
    parts = found.select("digest", "n_bytes", "salt").distinct().join(groups, ["digest", "n_bytes"])
    repeats = Window.partitionBy("digest", "n_bytes", "salt", "doc_id").orderBy("doc_id")
    out = found.join(parts, ["digest", "n_bytes", "salt"], "left").withColumn("nth", F.row_number().over(repeats))
    keep = F.when(F.col("keep_id") == _LAST, F.col("doc_id")).otherwise(F.coalesce("keep_id", "doc_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs' rows, with its own columns, of which one of each group of equal texts stays."""
    kept = exact_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    names = docs.columns
    here = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs["doc_id"].alias("d_id"), F.sha2(F.encode(normalised(docs["text"]), "UTF-8"), 256).alias("d_sha"))
    both = here.join(kept, here["d_id"].eqNullSafe(kept["k_id"]) & (here["d_sha"] == kept["k_sha"]))
    one = both.withColumn("nth", F.row_number().over(Window.partitionBy("d_id", "d_sha").orderBy("d_id"))).filter("nth = 1")
    return one.select(*[F.col("doc").getField(c).alias(c) for c in names])


SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""


def op9_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
