"""Facts from text: measurement rules, and the parsing and filtering of model output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.functions.text import is_fragment, is_placeholder
from graphloom.protocols import ENTITY_TYPES, RICH_PROMPT, TRIPLES_PROMPT, TextModel, ask_once, prompted
from graphloom.schemas import RICH_JSON, TRIPLES_JSON
from graphloom.settings import DEFAULTS, Settings

# fixed values: pattern, subject, relationship, text before and after the value, subject type, object type
MEASUREMENTS = (
    (r"([\d,]+(?:\.\d+)?)\s*CFMs?\b", "Blower Door Test", "RECORDED", "", " CFMs", "Event", "Measurement"),
    (r"([\d]+(?:\.\d+)?)\s*ACH", "Air Leakage Test", "RECORDED", "", " ACH50", "Event", "Measurement"),
    (r"\bR-?(\d+)\b", "Insulation", "HAS_VALUE", "R-", "", "Topic", "Measurement"),
    (r"([\d]+(?:\.\d+)?)\s*(?:KPA|kPa|Pa)\b", "Pressure Test", "RECORDED", "", " Pa", "Event", "Measurement"),
    (r"([\d]+(?:\.\d+)?)\s*(?:degrees?\s*[FCfc]|°[FCfc])", "Temperature", "RECORDED", "", "", "Measurement", "Measurement"),
    (r"([\d,]+(?:\.\d+)?)\s*BTU", "HVAC System", "RATED", "", " BTU", "Topic", "Measurement"),
)

_FIELDS = ("subject", "relationship", "object", "subject_type", "object_type")


def _rule(text: Column, pattern: str, subject: str, relationship: str, before: str, after: str, subject_type: str, object_type: str) -> Column:
    def triple(value: Column) -> Column:
        obj = F.concat(F.lit(before), F.replace(value, F.lit(","), F.lit("")), F.lit(after))
        return F.struct(F.lit(subject).alias("subject"), F.lit(relationship).alias("relationship"), obj.alias("object"), F.lit(subject_type).alias("subject_type"), F.lit(object_type).alias("object_type"))

    return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1)), triple)


def measurements(text: Column) -> Column:
    """array<struct> of the distinct measurement triples in a text; null gives none."""
    none = F.array().cast("array<struct<subject:string,relationship:string,object:string,subject_type:string,object_type:string>>")
    return F.array_distinct(F.coalesce(F.concat(*[_rule(text, *m) for m in MEASUREMENTS]), none))


#: Distinct texts that are sent to their readings; beyond it readings and texts are shuffled.
TEXTS = 20_000


def measured(readings: DataFrame) -> DataFrame:
    """id and the measurement triples of readings (id, text), each once an id.

    A distinct text is read once, whatever the number of its readings; triples meet as numbers, and those of
    an id in one array, whose texts are distinct.
    """
    texts = cut(readings.select("text").filter("text is not null").distinct().withColumn("found", measurements(F.col("text"))))
    every = texts.select("text", F.inline("found"))
    numbers = cut(every.select(*_FIELDS).distinct().withColumn("_m", F.monotonically_increasing_id()))
    sent = F.broadcast if texts.count() <= TEXTS else lambda rows: rows
    of = cut(every.join(sent(numbers), [*_FIELDS]).groupBy("text").agg(F.sort_array(F.collect_list("_m")).alias("_ms")))
    held = readings.join(sent(of), "text").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("_ms"))).alias("_ms"))
    return held.select("id", F.explode("_ms").alias("_m")).join(sent(numbers), "_m").select("id", *_FIELDS)


def keep_named(triples: DataFrame) -> DataFrame:
    """Without triples whose subject or object is a placeholder or a clause."""
    s, o = F.coalesce("subject", F.lit("")), F.coalesce("object", F.lit(""))
    return triples.filter(~is_placeholder(s) & ~is_placeholder(o) & ~is_fragment(s) & ~is_fragment(o))


def parse_triples(raw: DataFrame) -> DataFrame:
    """Triples of model output (chunk_id, response, text): named ones, and the text's measurements after them.

    A response that is no JSON object gives nothing at all, and neither do its measurements.
    """
    parsed = raw.withColumn("_p", F.from_json("response", TRIPLES_JSON)).filter(F.col("_p").isNotNull() & F.col("_p.triples").isNotNull())
    model = keep_named(parsed.select("chunk_id", F.inline("_p.triples")))
    rules = parsed.select("chunk_id", F.inline(measurements(F.col("text"))))
    return model.withColumn("origin", F.lit("model")).unionByName(rules.withColumn("origin", F.lit("rule")))


def parse_rich(raw: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of model output (chunk_id, response): from the first { to the last }; of a chunk `most` relationships, the first.

    Any entity without one of its keys voids the chunk; such a relationship voids the
    relationships and leaves the entities.
    """
    got = raw.withColumn("_p", F.from_json(F.regexp_extract("response", r"(?s)\{.*\}", 0), RICH_JSON)).filter("_p is not null")
    full = lambda col, keys: F.forall(F.coalesce(F.col(col), F.array()), lambda x: ~F.exists(F.array(*[x[k].isNull() for k in keys]), lambda b: b))
    e_keys, r_keys = ("entity_name", "entity_type", "entity_description"), ("source_entity", "target_entity", "relation", "relationship_description")
    good = got.filter(full("_p.entities", e_keys))
    entities = good.select("chunk_id", F.inline("_p.entities"))
    told = F.col("_p.relationships") if most is None else F.slice("_p.relationships", 1, most)
    relationships = good.filter(full("_p.relationships", r_keys)).select("chunk_id", F.inline(told))
    return entities, relationships


def extract_triples(chunks: DataFrame, model: Callable[[], TextModel], s: Settings = DEFAULTS, ledger: str | None = None) -> DataFrame:
    """Triples, with provenance and `origin`, of chunks (chunk_id, text, source, page_number, bbox, section).

    As many calls are under way as the settings allow; a chunk whose call fails gives nothing. Each
    prompt is asked once; ledger: where answers are kept from run to run.
    """
    asked = chunks.select("chunk_id", "text", prompted(TRIPLES_PROMPT, types=", ".join(ENTITY_TYPES), text=F.col("text")).alias("_asked"))
    told = ask_once(asked, "_asked", "response", model, ledger, workers=s.max_concurrent_extractions)
    found = parse_triples(told.select("chunk_id", "response", "text"))
    return found.join(chunks.select("chunk_id", "source", "page_number", "bbox", "section"), "chunk_id")


def extract_rich(chunks: DataFrame, model: Callable[[], TextModel], s: Settings = DEFAULTS, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) with descriptions of chunks (chunk_id, text), a bounded number of relationships each; each prompt is asked once for both."""
    asked = chunks.select("chunk_id", prompted(RICH_PROMPT, most=str(s.max_triplets_per_chunk), text=F.col("text")).alias("_asked"))
    told = ask_once(asked, "_asked", "response", model, ledger, workers=s.extraction_workers)
    return parse_rich(told.select("chunk_id", "response"), s.max_triplets_per_chunk)


def stamp(triples: DataFrame, source: Column, page: Column | None = None, bbox: Column | None = None, section: Column | None = None) -> DataFrame:
    """With provenance; values that the triple has stay where the given one is null."""
    out = triples
    for name, value in (("source", source), ("page_number", page), ("bbox", bbox), ("section", section)):
        if value is not None:
            out = out.withColumn(name, F.coalesce(value, F.col(name)) if name in out.columns else value)
    return out
