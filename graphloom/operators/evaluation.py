"""Evaluation aggregates: means by lane, winners, zero-context counts, load-test percentiles, lexical proxies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import NO_CONTEXT, words

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def mean(metric: str) -> Column:
    """Mean to three digits, NaN and null left out."""
    return F.round(F.avg(F.when(~F.isnan(metric), F.col(metric))), 3)


def lane_means(rows: DataFrame, metrics: tuple[str, ...] = METRICS, by: str = "lane") -> DataFrame:
    return rows.groupBy(by).agg(*[mean(m).alias(m) for m in metrics])


def winners(means: DataFrame, first: str, second: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, both lanes' means, winner (or tie)."""
    one = means.filter(F.col("lane").isin(first, second)).groupBy().agg(*[F.max(F.when(F.col("lane") == lane, F.col(m))).alias(f"{lane}_{m}") for lane in (first, second) for m in metrics])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{first}_{m}").alias("first"), F.col(f"{second}_{m}").alias("second")) for m in metrics])
    each = one.select(F.inline(cells))
    return each.withColumn("winner", F.when(F.col("first") > F.col("second"), first).when(F.col("second") > F.col("first"), second).otherwise("tie"))


def zero_contexts(rows: DataFrame, by: str = "strategy") -> DataFrame:
    """Per group the number of questions, of those without any context (or the placeholder alone), and their share."""
    empty = (F.size("contexts") == 0) | (F.col("contexts") == F.array(F.lit(NO_CONTEXT)))
    return rows.groupBy(by).agg(F.count("*").alias("questions"), F.count_if(empty).alias("zero_context"), F.round(F.count_if(empty) / F.count("*"), 3).alias("rate"))


def without_placeholder(contexts: Column) -> Column:
    return F.when(contexts == F.array(F.lit(NO_CONTEXT)), F.array().cast("array<string>")).otherwise(contexts)


def at_rank(values: Column, share: float) -> Column:
    """The value at place floor(n * share) from 0 of the sorted values, the last at most."""
    return F.get(values, F.least(F.floor(F.size(values) * share), F.size(values) - 1).cast("int"))


def latency(rows: DataFrame, by: str = "backend", value: str = "latency_ms", shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per group n, least, percentiles and greatest of a load test's latencies.

    The places are found by counts of distinct values, so that no group is gathered in one row.
    """
    from pyspark.sql import Window

    counts = rows.filter(f"{value} is not null").groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    up = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda s: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * s), F.col("n") - 1), F.col("v")))
    return up.groupBy(by).agg(F.max("n").alias("n"), F.min("v").alias("least"), *[at(s).alias(f"p{round(100 * s)}") for s in shares], F.max("v").alias("most"))


def throughput(rows: DataFrame, wall_seconds: Column, by: str = "backend") -> DataFrame:
    """Requests a second, and mean and greatest CPU share and memory of a load test's samples."""
    return rows.groupBy(by).agg(F.count("*").alias("total_requests"), F.round(F.count("*") / F.max(wall_seconds), 2).alias("throughput_rps"), F.round(F.avg("cpu_pct"), 1).alias("cpu_avg"), F.max("cpu_pct").alias("cpu_max"), F.round(F.avg("memory_mb"), 1).alias("memory_avg"), F.max("memory_mb").alias("memory_max"))


def ingestion_totals(files: DataFrame) -> DataFrame:
    """files (file, triples): all, triples, and files that gave none."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("triples"), F.lit(0)).cast("long").alias("triples"), F.count_if(F.coalesce("triples", F.lit(0)) == 0).alias("failed"))


def load_tallies(triples: DataFrame) -> DataFrame:
    ends = triples.select(F.explode(F.array("subject", "object")).alias("name"))
    return triples.agg(F.count("*").alias("triples_loaded")).join(ends.agg(F.count_distinct("name").alias("entities")))


def _share(of: Column, within: Column) -> Column:
    w, text = F.array_distinct(words(F.lower(of))), F.lower(within)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.filter(w, lambda x: F.contains(text, x))) / F.size(w))


def lexical_scores(rows: DataFrame) -> DataFrame:
    """Stand-ins for a judge, from shared words alone: rows (question, answer, contexts, ground_truth) with `*_lexical`."""
    joined = F.array_join("contexts", " ")
    precision = F.when(F.size("contexts") == 0, 0.0).otherwise(F.aggregate("contexts", F.lit(0.0), lambda s, c: s + F.when(_share(F.col("ground_truth"), c) >= 0.5, 1.0).otherwise(0.0)) / F.size("contexts"))
    return rows.withColumns({"faithfulness_lexical": _share(F.col("answer"), joined), "answer_relevancy_lexical": _share(F.col("question"), F.col("answer")), "context_precision_lexical": precision, "context_recall_lexical": _share(F.col("ground_truth"), joined)})
