"""Ingest, evaluation and the splitting by tokens as whole plans."""

import json
import math
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from graphloom import protocols
from graphloom.operators import chunking, community, evaluation, graph, rank
from graphloom.plans import evaluate, ingest, lanes
from graphloom.settings import Settings
from graphloom.sources import readers
from graphloom.streaming import merge

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find this module


class Parser:
    def parse(self, path, content):
        text = content.decode()
        if text == "broken":
            raise ValueError
        return json.dumps([{"type": "heading", "content": "Top", "page": 1}, {"type": "paragraph", "content": text, "page": 2}] if text.strip() else [])


class Model:
    def __call__(self, prompts):
        texts = [p.rsplit("Text:\n", 1)[1] for p in prompts]
        return [json.dumps({"triples": [{"subject": "Ann", "relationship": "RUNS", "object": t.split()[0], "subject_type": "Person", "object_type": "Topic"}] if "runs" in t else []}) for t in texts]


@pytest.fixture
def folder(tmp_path):
    for name, text in (("a.pdf", "Mills runs at R-20"), ("b.PDF", "broken"), ("c.jpg", " "), ("d.txt", "no file of ours"), ("e.pdf", "nothing to tell")):
        path = tmp_path / "in" / "unstructured" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    tables = tmp_path / "in" / "structured"
    tables.mkdir()
    (tables / "regions.csv").write_text("id,name\nr1,North\n")
    (tables / "customers.csv").write_text("id,name,company_name,region_id,email,customer_since\nk1,Cy,Cy Ltd,r1,c@x,2021\n")
    return tmp_path / "in"


def test_a_folder_is_ingested_to_the_graph(spark, folder, tmp_path):
    root = str(tmp_path / "graph")
    report = ingest.ingest_graph(spark, str(folder), root, Parser(), Model, Settings(max_concurrent_extractions=2), str(tmp_path / "ledger"))
    assert {r.source: (r.triples, r.status) for r in report.collect()} == {"a.pdf": (2, "ok"), "b.PDF": (0, "failed"), "c.jpg": (0, "empty"), "e.pdf": (0, "none"), "structured_csv": (5, "ok")}
    assert ingest.totals(report).first().asDict() == {"files": 5, "triples": 7, "failed": 3}
    nodes, edges = merge.read_graph(spark, root)
    facts = {(r.src_name, r.relationship, r.dst_name, r.source, r.page_number, r.section) for r in graph.triplets(nodes, edges).collect()}
    assert {("Ann", "RUNS", "Mills", "a.pdf", 2, "Top"), ("Insulation", "HAS_VALUE", "R-20", "a.pdf", 2, "Top"), ("Cy", "LOCATED_IN", "North", "structured_csv", None, None)} <= facts and len(facts) == 7
    members = community.communities(community.graph_of(graph.triplets(nodes, edges)))
    assert {r.node for r in members.collect()} == {r.name for r in nodes.collect()}


def test_an_empty_folder_is_ingested(spark, tmp_path):
    (tmp_path / "none").mkdir()
    report = ingest.ingest_graph(spark, str(tmp_path / "none"), str(tmp_path / "g"), Parser(), Model)
    assert [(r.source, r.triples, r.status) for r in report.collect()] == [("structured_csv", 0, "none")]
    assert merge.read_graph(spark, str(tmp_path / "g"))[1].count() == 0


def test_a_folder_is_ingested_to_chunks(spark, folder, tmp_path):
    root = str(tmp_path / "s")
    got = {r.source: r.chunks for r in ingest.ingest_chunks(spark, str(folder), root, Parser()).collect()}
    assert got == {"regions.csv": 1, "customers.csv": 1, "a.pdf": 2, "e.pdf": 2}
    texts = {r.text for r in spark.read.parquet(f"{root}/chunks").collect()}
    assert "customers: id=k1 | name=Cy | company_name=Cy Ltd | region_id=r1 (North) | email=c@x | customer_since=2021" in texts and "Mills runs at R-20" in texts


def test_files_are_routed_by_kind(spark, folder):
    got = {(r.path.rsplit("/", 1)[1], r.kind) for r in readers.read_files(spark, str(folder)).collect()}
    assert got == {("a.pdf", "pdf"), ("b.PDF", "pdf"), ("c.jpg", "image"), ("d.txt", "other"), ("e.pdf", "pdf"), ("regions.csv", "csv"), ("customers.csv", "csv")}
    assert {r.kind for r in readers.read_files(spark, str(folder), "*.csv").collect()} == {"csv"}
    assert readers.read_files(spark, str(folder / "unstructured"), recursive=False).count() == 5


# ---- evaluation


def _questions(spark, tmp_path):
    rows = [{"id": 1, "category": "a", "question": "who runs the mill", "ground_truth": "Ann runs"}, {"id": 2, "category": "b", "question": "zzz", "ground_truth": "nothing"}]
    (tmp_path / "q.json").write_text(json.dumps(rows, indent=1))
    return readers.read_questions(spark, str(tmp_path / "q.json"))


def _lane(context):
    return lambda asked: asked.withColumn("context", F.when(F.col("query") == 1, context)).withColumn("answer", F.coalesce("context", F.lit("none")))


def test_questions_are_read_whole(spark, tmp_path):
    assert [(r.id, r.category, r.question, r.ground_truth, r.source) for r in _questions(spark, tmp_path).orderBy("id").collect()] == [(1, "a", "who runs the mill", "Ann runs", None), (2, "b", "zzz", "nothing", None)]


def test_evaluation_from_questions_to_winners(spark, tmp_path):
    means, winners = evaluate.evaluate(_questions(spark, tmp_path), {"graph": _lane("- Ann runs the mill\n- b"), "chunks": _lane("Bo sits\n\n---\n\nthe mill")}, str(tmp_path / "out"), pause=0.0)
    got = {r.lane: r for r in means.collect()}
    assert got["graph"].context_recall == 0.5 and got["chunks"].context_recall == 0.0 and got["graph"].context_precision == 0.25
    assert {r.metric: r.winner for r in winners.collect()}["context_recall"] == "graph"
    held = spark.read.json(str(tmp_path / "out" / "results"))
    assert {(r.lane, r.id): r.contexts for r in held.collect()} == {("graph", 1): ["Ann runs the mill", "b"], ("graph", 2): ["No context retrieved."], ("chunks", 1): ["Bo sits", "the mill"], ("chunks", 2): ["No context retrieved."]}


def test_a_judge_that_fails_loses_nothing(spark, tmp_path):
    limit = tmp_path / "quota"

    class Judge:
        def __call__(self, rows):
            if limit.exists() and "b" in rows[0]["question"]:
                raise RuntimeError("quota")
            with (tmp_path / "calls").open("a") as f:
                f.write(rows[0]["question"] + "\n")
            return [{"faithfulness": 0.5, "answer_relevancy": 1.0, "context_precision": 0.0, "context_recall": 0.25}]

    rows = spark.createDataFrame([("a", "x", ["c"], "g"), ("b", "x", [], "g"), ("a", "x", ["c"], "g")], "question string, answer string, contexts array<string>, ground_truth string")
    limit.touch()
    first = evaluate.score(rows, Judge, str(tmp_path / "l"), retries=1, pause=0.0).collect()
    assert sorted((r.question, math.isnan(r.faithfulness)) for r in first) == [("a", False), ("a", False), ("b", True)]
    limit.unlink()
    again = evaluate.score(rows, Judge, str(tmp_path / "l"), retries=1, pause=0.0).collect()
    assert {r.faithfulness for r in again} == {0.5} and (tmp_path / "calls").read_text() == "a\nb\n"
    assert evaluation.lane_means(spark.createDataFrame(first).withColumn("lane", F.lit("l"))).first().faithfulness == 0.5


def test_a_judge_takes_keys_in_turn():
    def client(key, row):
        if key == "k1" or row["question"] == "all":
            raise protocols.RateLimited
        return {"faithfulness": 1.0}

    assert protocols.RotatingJudge(["k1", "k2"], client)([{"question": "q"}, {"question": "all"}, {"question": "q"}]) == [{"faithfulness": 1.0}, None, {"faithfulness": 1.0}]


def test_lexical_scores_agree_with_the_judge(spark):
    rows = [("who runs", "Ann runs", ["Ann runs it", "Bo"], "ann"), ("", "", [], ""), ("a b c d", "d", ["x"], "y z")]
    frame = spark.createDataFrame(rows, "question string, answer string, contexts array<string>, ground_truth string")
    told = protocols.LexicalJudge()([dict(zip(("question", "answer", "contexts", "ground_truth"), r)) for r in rows])
    got = evaluation.lexical_scores(frame).collect()
    assert [{m: r[f"{m}_lexical"] for m in evaluation.METRICS} for r in got] == [pytest.approx(t) for t in told]


# ---- splitting by tokens


def _bpe():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    return lambda texts: [len(x.ids) for x in held.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.skipif(not Path("/opt/tokenizers/word_bpe_49k.json").exists(), reason="no public tokenizer here")
def test_no_chunk_is_over_the_budget(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, " \n\n "), (-3, "x" * 5000), (-4, "word " * 3000)], "doc long, text string"))
    got = chunking.sentence_chunks(docs, _bpe, 128, 20).collect()
    count = _bpe()
    assert all(n <= 128 for n in count([r.text for r in got])) and [r.tokens for r in got[:50]] == count([r.text for r in got[:50]])
    assert {r.doc for r in got} >= {-3, -4} and not {r.doc for r in got} & {-1, -2}
    assert "".join(r.text for r in sorted(got, key=lambda r: r.place) if r.doc == -3) == "x" * 5000


def test_overlap_is_of_whole_sentences(spark):
    docs = spark.createDataFrame([("d", "One two. Three four! Five six? Seven.\n\nEight nine ten")], "doc string, text string")
    got = [r.text for r in chunking.sentence_chunks(docs, chunking.words_as_tokens, 5, 2).orderBy("place").collect()]
    assert got == ["One two. Three four!", "Three four! Five six? Seven.", "Seven. Eight nine ten"]
    with pytest.raises(ValueError, match="overlap"):
        chunking.sentence_chunks(docs, chunking.words_as_tokens, 5, 5)


def test_lanes_take_stored_graphs(spark, folder, tmp_path):
    ingest.ingest_graph(spark, str(folder), str(tmp_path / "g"), Parser(), Model)
    nodes, edges = merge.read_graph(spark, str(tmp_path / "g"))
    asked = spark.createDataFrame([(1, "where is Cy located")], "query long, question string")
    assert "Cy LOCATED IN North" in lanes.graph_lane(edges, nodes, asked).first().context


def test_equal_questions_and_alike_names_meet_once(spark, monkeypatch):
    """Equal questions are embedded once; of names with one vector the first alone are indexed; results are those of all."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        calls.add(1)
        return [1.0, float(len(text) % 3)]

    questions = spark.range(40).select(F.col("id").alias("query"), F.concat(F.lit("what about zz"), (F.col("id") % 2).cast("string")).alias("question"))
    asked = lanes.embedded(questions, embed)
    assert asked.count() == 40 and asked.filter("embedding is null").isEmpty() and calls.value == 2
    items = spark.range(90).select(F.format_string("zz1 n%02d", "id").alias("name"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("embedding"))
    sizes, build = [], rank.vector_index.build
    monkeypatch.setattr(rank.vector_index, "build", lambda *a, **k: sizes.append(a[0].count()) or build(*a, **k))
    found = rank.vector_seeds(items, asked, 2, -2.0, "cosine").collect()
    assert sizes == [6]  # three vectors, two names each
    near = len("what about zz0") % 3
    assert {(r.query, r["name"], r.score, r["rank"]) for r in found} == {(q, f"zz1 n{near + 3 * i:02}", 1.0, i + 1) for q in range(40) for i in range(2)}
    words = rank.keyword_seeds(items, asked, 2).collect()
    assert {(r.query, r["name"], r.hits, r["rank"]) for r in words} == {(q, f"zz1 n{i:02}", 1, i + 1) for q in range(1, 40, 2) for i in range(2)}


def test_typed_edges_are_the_triplets(spark):
    """The types of nodes that are met with several, and of those with one, without a join of edges with all nodes."""
    rows = [("a", "R", "b", "X", "Y", 3), ("a", "R", "b", "Z", "Y", 1), ("b", "S", "c", "Q", None, 2), ("c", "S", "a", "W", "V", 5), ("d", "r s", "e", "X", "Y", 4), ("d", "r s", "d", "X", "X", 9)]
    t = spark.createDataFrame([(*r[:5], f"s{r[5]}", None, None, None, r[5]) for r in rows], "subject string, relationship string, object string, subject_type string, object_type string, source string, page_number long, bbox array<double>, section string, seq long")
    want = graph.triplets(graph.nodes(t, "name"), graph.edges(t, "name"))
    found = graph.typed_edges(t)
    assert found.columns == want.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_items_edges_are_merged_where_their_part_lies(spark, sf_dir):
    """An item's row is shuffled once: its triples aren't dealt again by their hash, and the edges are those of all triples."""
    from graphloom import queries

    want = graph.typed_edges(queries.star(spark, sf_dir))
    got = graph.typed_edges(queries.star(spark, sf_dir, "customer", "part", "orders"), queries.star(spark, sf_dir, "lineitem", dealt=True))
    sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    assert sums(got) == sums(want)
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(_hash")
    lines = graph.typed_edges(queries.star(spark, sf_dir, "lineitem", dealt=True))
    assert dealt(lines) == 0 and "hashpartitioning(_by" not in lines._jdf.queryExecution().executedPlan().toString() and dealt(got) == 1


def test_chunks_are_handed_over_in_parts(spark, monkeypatch):
    """A worker doesn't hold all chunks of an Arrow batch."""
    monkeypatch.setattr(chunking, "HELD", 20)
    made, told = [], chunking._told
    monkeypatch.setattr(chunking, "_told", lambda docs, rows: made.append(len(rows)) or told(docs, rows))
    docs = spark.createDataFrame([(i, "one two. three four. five six.") for i in range(9)] + [(9, None)], "doc long, text string")
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f))
    chunking.sentence_chunks(docs, chunking.words_as_tokens, 2, 0)
    import pyarrow as pa

    out = pa.Table.from_batches(run[0](iter(pa.Table.from_pandas(docs.toPandas()).to_batches())))
    assert max(made) <= 3 and [tuple(r.values()) for r in out.to_pylist()] == [(d, p, x, 2) for d in range(9) for p, x in enumerate(("one two.", "three four.", "five six."))]


def test_one_hop_lanes_merge_the_seeds_edges_alone(spark, sf_dir, monkeypatch):
    """The queries of one hop hand all triples of the star schema to no merge of edges, but those that touch a seed."""
    from graphloom import queries

    seen, real = [], queries.graph.touching
    monkeypatch.setattr(queries.graph, "touching", lambda *a: seen.append(1) or real(*a))
    queries.both_lanes_answers(spark, sf_dir)
    assert seen == [1]
    with pytest.raises(ValueError, match="one hop"):
        lanes._edges_of(lambda starts: starts, None, 2)
