"""A store of embeddings under the hash of their texts, so that only new texts are embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.protocols import Embedder, default_embedder
from graphloom.sources import versions


def embedded(rows: DataFrame, path: str, embed: Embedder = default_embedder) -> DataFrame:
    """rows (text, ...) with embedding, from the store under path.

    Each distinct text that the store lacks is embedded once and added; texts that rows no longer have
    are dropped from it. A run without new or vanished texts writes nothing.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = cut(keyed.groupBy("_key").agg(F.first(F.coalesce("text", F.lit(""))).alias("_text")))
    old = versions.read(spark, path)
    new = texts if old is None else cut(texts.join(old.select("_key"), "_key", "left_anti"))
    kept = None if old is None else old.join(texts.select("_key"), "_key", "left_semi")
    if old is None or not new.isEmpty() or kept.count() < old.count():
        made = new.select("_key", embed(F.col("_text")).alias("embedding"))
        versions.write(spark, path, made if kept is None else kept.unionByName(made))
    return keyed.join(versions.read(spark, path), "_key", "left").drop("_key")
