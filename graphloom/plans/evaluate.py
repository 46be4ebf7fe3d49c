"""Evaluation as one plan: a question set through the lanes, the results scored by a judge, means and winners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import split_chunks, split_facts
from graphloom.operators import evaluation
from graphloom.protocols import Judge, LexicalJudge, judged
from graphloom.sources import readers


def run_lanes(questions: DataFrame, lanes: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """lane, id, category, question, answer, contexts, ground_truth of a question set (id, category, question, ground_truth).

    lanes: by name, from questions (query, question) to rows with query, context and answer. A lane
    whose name begins with `chunks` has its context taken apart by chunks, any other by facts; without
    context the standard text stands in.
    """
    asked, out = questions.select(F.col("id").alias("query"), "question"), None
    for name, lane in lanes.items():
        split = split_chunks if name.startswith("chunks") else split_facts
        got = lane(asked).select(F.col("query").alias("id"), "answer", split(F.coalesce("context", F.lit(""))).alias("contexts"))
        rows = questions.join(got, "id", "left").select(F.lit(name).alias("lane"), "id", "category", "question", "answer", F.coalesce("contexts", split(F.lit(""))).alias("contexts"), "ground_truth")
        out = rows if out is None else out.unionByName(rows)
    return out


def score(results: DataFrame, judge: Callable[[], Judge] = LexicalJudge, ledger: str | None = None, **calls) -> DataFrame:
    """results with the four metrics, NaN where the judge failed; the text that stands in for no context isn't shown to it."""
    shown = results.withColumn("_held", F.col("contexts")).withColumn("contexts", evaluation.without_placeholder(F.col("contexts")))
    return judged(shown, judge, evaluation.METRICS, ledger, **calls).withColumn("contexts", F.col("_held")).drop("_held")


def evaluate(questions: DataFrame, lanes: dict[str, Callable[[DataFrame], DataFrame]], folder: str, judge: Callable[[], Judge] = LexicalJudge, **calls) -> tuple[DataFrame, DataFrame]:
    """(means by lane, winner by metric between the first two lanes) of a question set; results, scores and means lie under folder.

    The judge's scores are kept in folder/judged from run to run.
    """
    spark = questions.sparkSession
    readers.write_results(run_lanes(questions, lanes), f"{folder}/results")
    kind = "lane string, id long, category string, question string, answer string, contexts array<string>, ground_truth string"
    scored = score(spark.read.schema(kind).json(f"{folder}/results"), judge, f"{folder}/judged", **calls)
    scored.write.mode("overwrite").parquet(f"{folder}/scored")
    means = evaluation.lane_means(spark.read.parquet(f"{folder}/scored"))
    readers.write_results(means.coalesce(1), f"{folder}/summary")
    first, second = list(lanes)[:2]
    return means, evaluation.winners(means, first, second)
