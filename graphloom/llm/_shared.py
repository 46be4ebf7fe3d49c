"""Helpers that the corpus operators share: checkpoints, partition counts, Bloom words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.checkpoints import cut, shared_folder, written

#: Words are maximal runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(run):
    """run, after whose last batch a worker gives freed memory back to the system; workers live on from stage to stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A Bloom filter has at most this many 64-bit words (16 MB); past it more rows get through, none is lost.
BLOOM_WORDS = 1 << 21


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the column's 64-bit hashes, as words, 16 bits a key up to BLOOM_WORDS.

    The driver receives the filter's words alone, whose number is bounded; the keys stay on the
    executors.
    """
    n, words = keys.count(), 64
    while words * 4 < n and words < BLOOM_WORDS:
        words *= 2
    h = F.col(column)
    bits = keys.select(F.explode(F.array(h, F.shiftrightunsigned(h, 17).bitwiseXOR(F.shiftleft(h, 23)))).alias("h"))
    got = (
        bits.select(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(words - 1).cast("long")).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    out = np.zeros(words, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bloom(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the hashes."""
    top = np.uint64(len(words) - 1)
    one = lambda x: (words[((x >> np.uint64(6)) & top).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
    return (one(h) & one((h >> np.uint64(17)) ^ (h << np.uint64(23)))).astype(bool)


__all__ = ["SPACE", "WORD", "bloom", "cut", "in_bloom", "partitions", "shared_folder", "table", "trimmed", "written"]
