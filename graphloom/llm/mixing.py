"""Mixing sources to target weights along a curriculum, with DataFrame operations alone.

Every source has a weight schedule over training time in [0, 1], piecewise linear. Its integral
is the source's demand for tokens; a document's place in its source's cumulative demand is put
through the inverse of that integral, which gives the time at which the document is trained on,
and documents are range-sorted by it.

Defined cases: a null text has size 0; a null source is a source of its own, after all others;
rows that agree in doc_id, source and size are peers and get the same decision; a source without
words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import WORD, cut

WEIGHTS = (3, 1, 2)
#: Relative weight at equidistant times, for the sources of each weight: early, even, late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _segments(knots: tuple[float, ...]) -> list[tuple[float, float, float, float, float, float]]:
    """(start, length, weight there, weight at its end, integral before, integral after), in all 1."""
    step = 1 / (len(knots) - 1)
    whole = sum((a + b) / 2 * step for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for i, (a, b) in enumerate(zip(knots, knots[1:])):
        area = (a + b) / 2 * step / whole
        out.append((i * step, step, a / whole, b / whole, done, done + area))
        done += area
    return out


def _time(share: Column, knots: tuple[float, ...]) -> Column:
    """When the integral of the schedule reaches share: per segment the root of a quadratic."""
    parts = _segments(knots)
    out = None
    for start, step, w0, w1, before, after in reversed(parts):
        c = (share - F.lit(before)) / F.lit(step)
        x = 2 * c / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0)) * c, F.lit(0.0))))
        here = F.lit(start) + F.lit(step) * x
        out = here if out is None else F.when(share <= F.lit(after), here).otherwise(out)
    return out


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Per source its size, class and target: the water level of the weights under the caps.

    sizes has one row a source, so the windows over all its rows are over sources, not documents.
    """
    ranked = sizes.withColumn("class", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("class") + 1))
    ranked = ranked.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    capped = F.lit(cap) * F.col("source_size")
    return ranked.withColumn("target", F.coalesce(F.least(F.col("weight") * water, capped), capped)).select("source", "source_size", "class", "target")


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: float = 2.0, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """One row per document, range-sorted by position: how often the mix takes it, and when.

    docs: doc_id, text, source. Returns doc_id, source, size, source_size, target, copies, taken,
    position (of the first copy, in [0, 1]; null if it is not taken), positions. The order of a
    source's documents is that of md5(doc_id), dealt into 4096 parts by its first digits: sums of
    parts come first, running sums within a part after, so no task sees a whole source.
    """
    doc = F.col("doc_id").cast("string")
    sized = cut(docs.select("doc_id", "source", F.md5(F.coalesce(doc, F.lit(""))).alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sized = sized.withColumn("part", F.substring("h", 1, 3))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    totals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), share, weights, cap)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    starts = _null_safe(starts.drop("part_size"), totals)
    kept = _null_safe(sized, starts, "part")
    peers = Window.partitionBy("source", "part").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("source", "part", "h", "doc_id", "size")
    kept = kept.withColumn("before", F.col("start") + F.sum("size").over(peers) - F.sum("size").over(same))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    more = (F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * rest)
    kept = kept.withColumn("copies", whole + more.cast("long"))
    place = lambda c: F.least((c * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target"), F.lit(1.0))
    when = lambda c: F.coalesce(*[F.when(F.col("class") % len(schedules) == i, _time(place(c), k)) for i, k in enumerate(schedules)])
    positions = F.when((F.col("copies") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), when)).otherwise(F.array().cast("array<double>"))
    kept = kept.withColumn("positions", positions).withColumn("position", F.get("positions", F.lit(0)))
    return kept.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "position", "positions").repartitionByRange(F.col("position").asc_nulls_last(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def _null_safe(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Joins on source, in which null equals null, and more columns."""
    right = right.withColumnsRenamed({c: f"r_{c}" for c in ("source", *more)})
    on = left["source"].eqNullSafe(right["r_source"])
    for c in more:
        on &= left[c] == right[f"r_{c}"]
    return left.join(right, on).drop("r_source", *[f"r_{c}" for c in more])


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: docs' rows, once per copy, range-sorted by their training positions."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    mixed = mix_sources(docs, **options).filter("copies > 0").select(F.col("doc_id").alias("r_doc"), F.col("source").alias("r_source"), F.col("size").alias("r_size"), "positions").dropDuplicates(["r_doc", "r_source", "r_size"])
    names = docs.columns
    here = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs["doc_id"].alias("l_doc"), docs["source"].alias("l_source"), size.alias("l_size"))
    both = here.join(mixed, here["l_doc"].eqNullSafe(mixed["r_doc"]) & here["l_source"].eqNullSafe(mixed["r_source"]) & (here["l_size"] == mixed["r_size"]))
    return both.select("doc", F.explode("positions").alias("position")).repartitionByRange("position", F.xxhash64("doc.doc_id")).sortWithinPartitions("position").select(*[F.col("doc").getField(c).alias(c) for c in names])


SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS class FROM p),
w AS (SELECT *, CASE class WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM r),
q AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - 2.0::DOUBLE * coalesce(CAST(sum(source_size) OVER b AS BIGINT), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
      FROM q WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(least(weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1), 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.class,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS LAST, d.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(d.size) OVER (PARTITION BY d.source, d.h, d.doc_id, d.size) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n FROM c),
e AS (SELECT *, n + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - n * source_size) THEN 1 ELSE 0 END AS copies FROM k),
f AS (SELECT *, CASE WHEN copies > 0 AND target > 0 THEN least((before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) END AS share FROM e)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(copies * size AS BIGINT) AS taken,
  round(CASE class WHEN 0 THEN 2 * share / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2 * share, 0)))
       WHEN 1 THEN share ELSE 2 * share / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * share)) END, 6) AS position
FROM f
"""


def op1_mix(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position"))
