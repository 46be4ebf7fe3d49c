"""Ingest of a folder as one plan: files and tables to triples and chunks, and these to the stored graph and chunk table.

Under a folder lie `structured` with the business tables as CSV, and `unstructured` with PDF and image
files; without the latter, the files lie in the folder itself. A file whose parser fails, that has no
text, or whose chunks give no triples is told in the report and stops no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.operators import chunking, evaluation, extract, triples
from graphloom.protocols import TextModel
from graphloom.schemas import BUSINESS
from graphloom.settings import DEFAULTS, Settings
from graphloom.sources import readers
from graphloom.streaming import merge

#: The section of triples from text, in their place: after those of all tables.
TEXT_SECTION = 100


def file_chunks(spark: SparkSession, folder: str, parser: readers.DocumentParser, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of the PDF and image files: source and failed of each file; chunk_id, source, text, page_number, bbox, section and place of their chunks."""
    inner = f"{folder}/unstructured"
    at = inner if readers.exists(spark, inner) else folder
    none = spark.createDataFrame([], "source string, failed boolean"), spark.createDataFrame([], "chunk_id string, source string, text string, page_number long, bbox array<double>, section string, place string")
    if not readers.exists(spark, f"{at}/*"):
        return none
    files = readers.read_files(spark, at, recursive=False).filter(F.col("kind").isin("pdf", "image"))
    parsed = cut(readers.parse_files(files, parser).withColumn("doc", F.regexp_extract("doc", r"([^/]+)$", 1)))
    found = chunking.chunks(readers.layout_elements(parsed), s.chunk_size, s.chunk_overlap)
    place = F.concat_ws("/", F.col("doc"), F.lpad(F.col("island").cast("string"), 12, "0"), F.lpad(F.col("start").cast("string"), 12, "0"))
    chunks = found.select(F.sha2(F.concat_ws("\x1f", place, "text"), 256).alias("chunk_id"), F.col("doc").alias("source"), "text", "page_number", "bbox", "section", place.alias("place"))
    return parsed.select(F.col("doc").alias("source"), F.col("layout").isNull().alias("failed")), cut(chunks)


def ingest_graph(spark: SparkSession, folder: str, root: str, parser: readers.DocumentParser, model: Callable[[], TextModel], s: Settings = DEFAULTS, ledger: str | None = None, key: str = "name_type", batch: int = -1) -> DataFrame:
    """Merges the folder's triples into the graph under root: source, chunks, triples, status of every file, and of the tables as one.

    status: ok, failed (the parser's), empty (no text) or none (no triples). ledger: where the model's
    answers are kept, so that a second run asks for new chunks alone.
    """
    files, chunks = file_chunks(spark, folder, parser, s)
    told = extract.extract_triples(chunks.select("chunk_id", "text", "source", "page_number", "bbox", "section"), model, s, ledger).join(chunks.select("chunk_id", "place"), "chunk_id")
    seq = F.struct(F.lit(TEXT_SECTION).alias("section"), F.col("place").alias("row"), F.when(F.col("origin") == "model", 0).otherwise(1).alias("rule"))
    text = cut(told.withColumn("seq", seq).select("subject", "relationship", "object", "subject_type", "object_type", "source", "page_number", "bbox", "section", "seq"))
    tables = cut(triples.business_triples(readers.read_business(spark, f"{folder}/structured")))
    merge.merge_batch(spark, tables.unionByName(text), root, key, batch)
    made = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    facts = text.groupBy("source").agg(F.count("*").alias("triples"))
    report = files.join(made, "source", "left").join(facts, "source", "left").fillna(0, ["chunks", "triples"])
    status = F.when(F.col("failed"), "failed").when(F.col("chunks") == 0, "empty").when(F.col("triples") == 0, "none").otherwise("ok")
    rows = report.select("source", "chunks", "triples", status.alias("status"))
    whole = tables.agg(F.lit(triples.SOURCE).alias("source"), F.lit(0).cast("long").alias("chunks"), F.count("*").alias("triples")).withColumn("status", F.when(F.col("triples") == 0, "none").otherwise("ok"))
    return cut(rows.unionByName(whole))


def totals(report: DataFrame) -> DataFrame:
    """files, triples, failed: over a report, of which a file without triples counts as failed."""
    return evaluation.ingestion_totals(report.select(F.col("source").alias("file"), "triples"))


def ingest_chunks(spark: SparkSession, folder: str, root: str, parser: readers.DocumentParser, s: Settings = DEFAULTS) -> DataFrame:
    """Replaces the chunk table under root by the folder's: a text a row of every table, and the files' chunks. source and chunks of each.

    In a row's text, names follow the ids of all tables that have an id and a name, but companies.
    """
    tables = readers.read_business(spark, f"{folder}/structured")
    out, names = None, None
    for name, rows in tables.items():
        if name not in ("company", "documents") and {"id", "name"} <= set(rows.columns):
            one = rows.select("id", "name")
            names = one if names is None else names.unionByName(one)
    for name in BUSINESS:
        rows = tables[name]
        key = "id" if "id" in rows.columns else rows.columns[0]
        text = triples.linearise(rows, name, names, key).select("text", F.lit(f"{name}.csv").alias("source"), F.lit(None).cast("long").alias("page_number"))
        out = text if out is None else out.unionByName(text)
    _, chunks = file_chunks(spark, folder, parser, s)
    every = cut(out.unionByName(chunks.select("text", "source", "page_number")))
    readers.write_chunks(every, f"{root}/chunks")
    return spark.read.parquet(f"{root}/chunks").groupBy("source").agg(F.count("*").alias("chunks"))
