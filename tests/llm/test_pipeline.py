import zlib

import brute
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_corpus_operators import check_packing, normal

from graphloom.llm import language_id


def test_stages(spark, docs, texts, tmp_path):
    source = docs.filter("doc_id not in (306, 307, 308)").select("doc_id", "text", "lang", "source", "n_chars")
    now, kept = source, {d: t for d, t in texts if d not in (306, 307, 308)}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        rows = now.collect()
        if name == "language id":
            net, names = language_id.fit(source.filter(~language_id.held_out(source, 3, 1)))
            told = {r["doc_id"]: r for r in language_id.identify(source, net, names).collect()}
            kept = {d: t for d, t in kept.items() if told[d]["lang_pred"] != "und" and told[d]["score"] >= language_id.MIN_SCORE}
            assert {r["doc_id"]: r["lang"] for r in rows} == {d: told[d]["lang_pred"] for d in kept}
        elif name == "exact dedup":
            first = {}
            for d in sorted(kept, reverse=True):
                first[normal(kept[d])] = d
            kept = {d: kept[d] for d in first.values()}
        elif name == "near dedup":
            found = brute.components(list(kept.items()))
            kept = {d: t for d, t in kept.items() if found[d][1] == d}
        if name in ("language id", "exact dedup", "near dedup"):
            assert now.columns == source.columns and sorted((r["doc_id"], r["text"]) for r in rows) == sorted(kept.items())
        elif name == "mixing":
            assert now.columns == source.columns and {r["doc_id"] for r in rows} <= set(kept) and all(kept[r["doc_id"]] == r["text"] for r in rows)
            words = {d: len(t.split()) for d, t in kept.items()}
            assert abs(sum(words[r["doc_id"]] for r in rows) / sum(words.values()) - 1.5) < 0.1
    # documents that the mix takes twice are packed twice
    distinct = {(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()}
    assert now.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).count() == len(distinct)
    for r in now.select("ids", "length", "ids_crc32").collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    one = before.dropDuplicates(["doc_id"])
    check_packing(corpus_pipeline.pack(spark, one, ""), list(distinct))


def test_stages_of_long_texts_and_clashing_names(spark, docs, texts, tmp_path):
    """Very long texts go through every stage whole, with a null id, and with further columns of the operators' own names."""
    some = docs.filter("doc_id in (306, 307, 308) or doc_id < 20").withColumns({c: F.lit("!") for c in ("component_id", "keep_id", "lang_pred", "score", "sequence_id", "positions")})
    now = some.unionByName(some.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("some words of a text without an id that nothing else has")))
    kept = {d: t for d, t in texts if d in (306, 307, 308) or d < 20}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        columns = now.columns
        stage(spark, now, "").write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        assert now.columns == columns
    rows = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
    assert all(kept[d] == t for d, t in rows.items() if d is not None)
    packed = corpus_pipeline.pack(spark, now.dropDuplicates(["doc_id"]), "")
    check_packing(packed, list(rows.items()))


def test_stages_of_an_empty_table(spark, nothing, tmp_path):
    now = nothing
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        assert now.count() == 0
