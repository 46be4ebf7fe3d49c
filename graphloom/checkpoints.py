"""Cutting lineage, in the folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where that is unset and all runs in one process.

    RuntimeError on a cluster without that setting, as no other folder is known to be shared.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: packed by columns, unlike a checkpoint's rows, and read in parts by size, however many tasks wrote it.

    It has the size of its files. A checkpoint keeps the size that the optimizer guessed, which each join
    multiplies: one round's guess has two or three times the digits of the last one's, so that what goes
    from round to round by checkpoints fills the driver with a number.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
