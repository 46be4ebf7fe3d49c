import json

import pytest
from pyspark.sql import functions as F

from graphloom import checkpoints, protocols, settings
from graphloom.functions import text as tx
from graphloom.functions import vectors
from graphloom.operators import chunking, community, evaluation, extract, graph, rank, triples, vector_index
from graphloom.plans import api, lanes
from graphloom.schemas import BUSINESS
from graphloom.sources import readers, versions
from graphloom.streaming import merge


@pytest.fixture(scope="module")
def business(spark):
    rows = {
        "company": [("c1", "Acme, Inc", "Retail", 1999)],
        "departments": [("d1", "Sales", "c1"), ("d2", "IT", "c1")],
        "regions": [("r1", "North")],
        "products": [("p1", "Lamp", "Home", 1234.5), ("p2", "Desk", "Home", 0.125)],
        "employees": [("e1", "Ann", "a@x", "CEO", "d1", None, "2020-01-01"), ("e2", "Bob", "b@x", "Rep", "d9", "e1", None)],
        "customers": [("k1", "Cy", "Cy Ltd", "r1", "c@x", "2021-05-05"), ("k2", "Di", None, None, None, None)],
        "orders": [("o1", "k1", "e2", "2022-01-01", "Shipped", 1000.0), ("o2", "k9", "e2", "2022-01-01", "Shipped", 7.0), ("o3", "k1", None, "2022", "Cancelled", 9.0), ("o4", "k2", "e1", "2022", "Cancelled", 9.5)],
        "order_items": [("i1", "o1", "p1", 2, 1.0, 2.0), ("i2", "o1", "p9", 1, 1.0, 1.0), ("i3", "o2", "p2", 1, 1.0, 1.0), ("i4", "o9", "p1", 5, 1.0, 5.0), ("i5", "o1", "p1", 2, 1.0, 2.0)],
        "documents": [],
    }
    return {n: spark.createDataFrame(rows[n], BUSINESS[n]) for n in BUSINESS}


def test_business_triples(business):
    got = {(r.subject, r.relationship, r.object) for r in triples.business_triples(business).collect()}
    assert got == {
        ("Acme, Inc", "IS_A", "Retail"), ("Acme, Inc", "FOUNDED_IN", "1999"), ("Sales", "IS_A", "Department"), ("Sales", "PART_OF", "Acme, Inc"), ("IT", "IS_A", "Department"), ("IT", "PART_OF", "Acme, Inc"), ("North", "IS_A", "Region"),
        ("Lamp", "IS_A", "Home"), ("Lamp", "PRICED_AT", "$1,234.50"), ("Desk", "IS_A", "Home"), ("Desk", "PRICED_AT", "$0.12"),
        ("Ann", "IS_A", "Employee"), ("Ann", "HAS_ROLE", "CEO"), ("Ann", "EMPLOYED_BY", "Acme, Inc"), ("Ann", "WORKS_IN", "Sales"), ("Ann", "HIRED_ON", "2020-01-01"),
        ("Bob", "IS_A", "Employee"), ("Bob", "HAS_ROLE", "Rep"), ("Bob", "EMPLOYED_BY", "Acme, Inc"), ("Bob", "REPORTS_TO", "Ann"),
        ("Cy", "IS_A", "Customer"), ("Cy", "REPRESENTS", "Cy Ltd"), ("Cy", "LOCATED_IN", "North"), ("Cy", "CUSTOMER_SINCE", "2021-05-05"), ("Di", "IS_A", "Customer"),
        ("Bob", "SOLD_TO", "Cy"), ("Cy", "ORDER_WORTH", "$1,000.00"), ("Ann", "SOLD_TO", "Di"), ("Di", "ORDER_WORTH", "$9.50"),
        ("Cy", "PURCHASED", "Lamp"), ("Bob", "SOLD", "Lamp"), ("Lamp", "ORDERED_QTY", "2"), ("Bob", "SOLD", "Desk"),
    }


def test_places_of_whole_and_text_keys_agree(spark):
    rows = [(2, "a", "x"), (10, "a", "x"), (None, "a", "x"), (7, "b", "x"), (7, "b", ""), (7, None, "x")]
    for kind, key in (("long", F.col("k")), ("string", F.lpad("k", 3, "0"))):
        t = spark.createDataFrame([(k if kind == "long" or k is None else str(k), s, o) for k, s, o in rows], f"k {kind}, s string, o string")
        rules = [triples.Rule(F.col("s"), "IS", F.col("o"), "A", "B"), triples.Rule(F.col("o"), "IS", F.col("s"), "C", "D")]
        every = triples.unpivot(t, rules, key, 0, F.coalesce(F.concat(F.lit("row"), F.col("k").cast("string")), F.lit("none"))).unionByName(triples.unpivot(t.filter("k = 7"), rules, key, 1, "late"))
        first = {(r.subject, r.object): r.source for r in triples.distinct_triples(every).collect()}
        assert first == {("a", "x"): "none", ("x", "a"): "none", ("b", "x"): "row7", ("x", "b"): "row7"}
        assert {r.name: r.type for r in graph.nodes(every, "name").collect()} == {"a": "A", "x": "B", "b": "A"}
        assert {(r.src, r.dst): (r.source, r.n) for r in graph.edges(every, "name").collect()} == {("a", "x"): ("none", 3), ("x", "a"): ("none", 3), ("b", "x"): ("row7", 2), ("x", "b"): ("row7", 2)}
    with pytest.raises(ValueError):
        triples.unpivot(spark.range(1), [triples.Rule(F.lit("a"), "IS", F.lit("b"))] * 11, F.col("id"))


def test_csv_tables_and_missing_files(spark, tmp_path):
    (tmp_path / "company.csv").write_text('id,name,industry,founded_year\nc1,"Acme, Inc",Retail,1999\n')
    got = readers.read_business(spark, str(tmp_path))
    assert got["company"].first().name == "Acme, Inc" and got["orders"].count() == 0
    assert triples.business_triples(got).count() == 2


def test_linearise(spark):
    rows = spark.createDataFrame([("o1", "k1", None, 12345678.5, True)], "id string, customer_id string, note string, total double, paid boolean")
    names = spark.createDataFrame([("k1", "Cy"), ("o1", "never")], "id string, name string")
    assert triples.linearise(rows, "orders", names).first().text == "orders: id=o1 | customer_id=k1 (Cy) | total=12345678.5 | paid=True"


@pytest.mark.parametrize("n, starts", [(0, [0]), (1, [0]), (1200, [0]), (1201, [0, 1050]), (2250, [0, 1050, 2100])])
def test_windows(spark, n, starts):
    got = spark.createDataFrame([("x" * n,)], "t string").select(F.inline(tx.windows(F.col("t"), 1200, 150))).collect()
    assert [r.start for r in got] == starts
    with pytest.raises(ValueError):
        tx.windows(F.col("t"), 100, 100)


def elements(spark, rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc string, pos long, type string, text string, page_number long, bbox array<double>")


def test_chunks_without_headings(spark):
    box = lambda y: [0.0, y, 9.0, y + 10]
    rows = [("text", "a", 1, box(0.0)), ("text", "  ", 1, None), ("text", "b", 1, box(50.0)), ("text", "c", 1, box(101.0)), ("table", "t", 1, box(120.0)), ("text", "d", 1, box(500.0)), ("text", "e", None, None), ("text", "f", None, None)]
    got = [(r.type, r.text) for r in chunking.chunks(elements(spark, rows)).orderBy("island", "start").collect()]
    assert got == [("text", "a\nb"), ("text", "c"), ("table", "t"), ("text", "d"), ("text", "e\nf")]


def test_chunks_with_headings_cross_pages(spark):
    rows = [("table", "t0", 1, None), ("heading", " H ", 1, None), ("text", "a", 1, None), ("text", "b", 2, [1.0, 2.0, 3.0, 4.0])]
    got = chunking.chunks(elements(spark, rows), 2, 0).orderBy("island", "start").collect()
    assert [(r.type, r.text, r.section, r.page_number) for r in got] == [("table", "t0", None, 1), ("heading", "H", "H", 1), ("text", "a", "H", 1), ("text", "b", "H", 2)]


def test_layout(spark):
    raw = {"kids": [{"type": "Title", "content": " Hi ", "page number": "2", "bounding box": [1, 2, 3, 4], "kids": [{"type": "list item", "text": "in"}]}, {"type": "Figure", "content": "no", "kids": [{"content": "nor this"}]}, {"type": "Header", "text": "x", "page": "iv", "bbox": [1]}]}
    docs = spark.createDataFrame([("a", json.dumps(raw)), ("b", "no json"), ("c", None), ("d", json.dumps([{"content": "y"}]))], "doc string, layout string")
    got = [(r.doc, r.pos, r.type, r.text, r.page_number, r.bbox) for r in readers.layout_elements(docs).orderBy("doc", "pos").collect()]
    assert got == [("a", 0, "heading", "Hi", 2, [1.0, 2.0, 3.0, 4.0]), ("a", 1, "text", "in", None, None), ("a", 2, "heading", "x", None, None), ("d", 0, "text", "y", None, None)]


def test_layout_with_bad_fields(spark):
    """A bad value voids its own field alone."""
    raw = [{"content": "a", "bbox": [1, None, 3, 4]}, {"content": "b", "bbox": ["1", "x", 3, 4], "page number": 0, "page": 3}, {"content": 5, "bbox": ["1", 2, 3, 4], "kids": "none"}, {"content": "c", "type": 7, "bbox": {"x": 1}, "page": [1]}, None, "text"]
    docs = spark.createDataFrame([("a", json.dumps(raw)), ("b", json.dumps({"kids": 3})), ("c", "7")], "doc string, layout string")
    got = [(r.pos, r.text, r.page_number, r.bbox) for r in readers.layout_elements(docs).orderBy("pos").collect()]
    assert got == [(0, "a", None, None), (1, "b", 3, None), (2, "5", None, [1.0, 2.0, 3.0, 4.0]), (3, "c", None, None)]


def test_polygons_and_tables(spark):
    rows = spark.createDataFrame([([[1.0, 5.0], [3.0, 2.0], [0.5, 4.0]], [["a", None], ["b", "c"]])], "points array<array<double>>, cells array<array<string>>")
    got = rows.select(chunking.bounding_box("points").alias("box"), chunking.table_text("cells").alias("text")).first()
    assert got.box == [0.5, 2.0, 3.0, 5.0] and got.text == "a | \nb | c"


def test_csv_folder(spark, tmp_path):
    assert [x.count() for x in readers.read_csv_folder(spark, str(tmp_path), "id long, name string")] == [0, 0]
    (tmp_path / "b.csv").write_text("id,name\n1,x\nbad,y\n")
    (tmp_path / "a.csv").write_text("id,name\n2,z\n")
    (tmp_path / "c.txt").write_text("id,name\n3,no\n")
    rows, failed = readers.read_csv_folder(spark, str(tmp_path), "id long, name string")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x", "b.csv"), (2, "z", "a.csv")]
    assert [tuple(r) for r in failed.collect()] == [("b.csv", "bad,y")]


def test_chunk_and_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("t", "s", None), (" ", "s", 1), ("u", None, 2)], "text string, source string, page_number long")
    for _ in range(2):  # the second replaces the first
        readers.write_chunks(rows, str(tmp_path / "chunks"))
    got = spark.read.parquet(str(tmp_path / "chunks")).collect()
    assert {(r.text, r.page_number) for r in got} == {("t", 0), ("u", 2)} and len({r.chunk_id for r in got}) == 2
    out = spark.createDataFrame([(1, ["a", "b"])], "query int, contexts array<string>")
    readers.write_results(out, str(tmp_path / "json"))
    readers.write_results(out, str(tmp_path / "csv"), "csv")
    assert spark.read.json(str(tmp_path / "json")).first().contexts == ["a", "b"]
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).first().contexts == '["a","b"]'
    (tmp_path / "keys.txt").write_text("k1\n\n k2 \n")
    assert readers.read_keys(spark, str(tmp_path / "keys.txt")) == ["k1", "k2"]


def test_settings_from_the_environment():
    got = settings.from_environment({"GRAPHLOOM_HOPS": "3", "GRAPHLOOM_SEED_MIN_SCORE": "0.5", "HOPS": "9"})
    assert (got.hops, got.seed_min_score, got.seed_limit) == (3, 0.5, 3)
    with pytest.raises(ValueError):
        settings.from_environment({"GRAPHLOOM_HOPS": "many"})


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        checkpoints.shared_folder(Session())


def test_default_embedding(spark):
    import hashlib

    texts = ["The lamp the", "", "Ünï x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", vectors.hashed_embedding(F.col("t")).alias("e")).orderBy("i").collect()
    for text, row in zip(texts, got):
        want = [0.0] * 64
        for w in text.lower().split():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:2], 16) % 64] += 1 if h[2] < "8" else -1
        size = sum(x * x for x in want) ** 0.5 or 1
        assert row.e == pytest.approx([x / size for x in want])


def test_vector_index_recall(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").cast("string").alias("name"), "embedding")
    asked = e.filter("cast(name as int) % 20 = 0").select(F.col("name").alias("query"), "embedding")
    vector_index.write_vectors(e, str(tmp_path / "v"), 16)
    index = vector_index.read_vectors(spark, str(tmp_path / "v"))
    assert index.count() == e.count()
    found = {(r.query, r["name"]) for r in vector_index.search(index, vector_index.read_centres(spark, str(tmp_path / "v")), asked, 5).collect()}
    exact = {(r.query, r["name"]) for r in rank.vector_seeds(e, asked, 5, -2.0, "cosine").collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    none = e.filter("false")
    assert vector_index.search(vector_index.assign(none, vector_index.fit(none)), vector_index.fit(none), asked, 5).count() == 0


def test_extraction_with_a_model(spark):
    class Model:
        def __call__(self, prompts):
            if any("broken" in p for p in prompts):
                raise RuntimeError
            assert all("UPPER_SNAKE" in p and '{"triples"' in p for p in prompts)
            return [json.dumps({"triples": [{"subject": "Ann", "relationship": "RUNS", "object": p.rsplit("Text:\n", 1)[1], "subject_type": "Person", "object_type": "Topic"}]}) for p in prompts]

    class Rich:
        def __call__(self, prompts):
            one = {"source_entity": "a", "target_entity": "b", "relation": "r", "relationship_description": "d"}
            return ["Sure: " + json.dumps({"entities": [], "relationships": [one | {"target_entity": str(i)} for i in range(9)]})] * len(prompts)

    chunks = spark.createDataFrame([("c1", "R-20 {x}", "s", 4, None, "H"), ("c2", "broken", "s", 5, None, None)], "chunk_id string, text string, source string, page_number long, bbox array<double>, section string")
    got = extract.extract_triples(chunks, Model, settings.Settings(max_concurrent_extractions=2)).collect()
    assert sorted((r.object, r.origin, r.page_number, r.section) for r in got) == [("R-20", "rule", 4, "H"), ("R-20 {x}", "model", 4, "H")]
    entities, relationships = extract.extract_rich(chunks, Rich)
    assert entities.count() == 0 and sorted(r.target_entity for r in relationships.filter("chunk_id = 'c1'").collect()) == ["0", "1", "2", "3", "4"]
    rows = spark.createDataFrame([(1, "q?", "", "none"), (2, "q?", "c", "x")], "query int, question string, context string, answer string")

    class Answerer:
        def __call__(self, prompts):
            return [p.splitlines()[0] + "|" + p.splitlines()[-1] for p in prompts]

    assert {r.query: r.answer for r in lanes.model_answers(rows, Answerer).collect()} == {1: "none", 2: "Answer from the facts alone.|Question: q?"}


def test_provenance_stamps(spark):
    t = spark.createDataFrame([("a", None), ("b", "own")], "subject string, source string")
    got = extract.stamp(t, F.lit("given"), F.lit(3).cast("long")).collect()
    assert [(r.source, r.page_number) for r in got] == [("given", 3), ("given", 3)]
    assert [r.source for r in extract.stamp(t, F.lit(None).cast("string")).collect()] == [None, "own"]


def test_community_lane(spark, tmp_path):
    pairs = [("Ann", "Acme", "RUNS", "since 1999"), ("Bob", "Acme", "WORKS_AT", ""), ("Cy", "Dee", "KNOWS", "well")]
    g = community.simple_graph(spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "src string, dst string, relationship string, description string, seq int"))
    members = community.communities(g)
    paths = spark.createDataFrame([("Ann -> runs -> Acme",), ("Cy -> knows -> Dee",)], "text string")
    asked = spark.createDataFrame([(1, "Ann runs"), (2, "Dee knows")], "query long, question string")
    stored = str(tmp_path / "told")
    got = {r.query: r.answer for r in lanes.community_lane(members, g, paths, asked, stored=stored).collect()}
    assert "Ann" in got[1] and "Dee" in got[2]
    assert versions.read(spark, stored).count() == members.select("cluster").distinct().count()


def test_summaries_that_nobody_asks_for_are_not_made(spark, monkeypatch):
    pairs = [("Ann", "Acme", "RUNS", "since 1999"), ("Cy", "Dee", "KNOWS", "well"), ("Eve", "Fay", "KNOWS", "")]
    g = community.simple_graph(spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "src string, dst string, relationship string, description string, seq int"))
    members, told, make = community.communities(g), [], lanes.community_summaries
    monkeypatch.setattr(lanes, "community_summaries", lambda m, *rest: told.append(make(m, *rest)) or told[-1])
    paths = spark.createDataFrame([("Ann -> runs -> Acme",)], "text string")
    asked = spark.createDataFrame([(1, "Ann runs")], "query long, question string")
    assert "since 1999" in lanes.community_lane(members, g, paths, asked).first().answer
    assert [r.cluster for r in told[0].collect()] == ["Acme/0"]


def test_edges_and_first_rows_are_dealt_before_they_are_sorted(spark):
    """No sort of whole rows in the tasks that make them; and of equal places the least source and page stay, whatever the order of rows."""
    rows = [("a", "R", "b", "T", "T", "x", p, None, None, 1) for p in (3, 2)]
    kinds = "subject string, relationship string, object string, subject_type string, object_type string, source string, page_number long, bbox array<double>, section string, seq long"
    for order in (rows, rows[::-1]):
        every = spark.createDataFrame(order, kinds).coalesce(1)
        assert [(r.subject, r.object, r.source, r.page_number, r.n) for r in graph.edges(every).collect()] == [("a", "b", "x", 2, 2)]
    for found in (graph.edges(every, "name"), triples.distinct_triples(every)):
        assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("sent", "key"), [(0, "name"), (100, "name"), (100, "name_type")])
def test_edges_of_touched_nodes_are_the_whole_graphs(spark, monkeypatch, sent, key):
    """By joins of either kind: an end's edges have the count and provenance that they have in the whole graph, and others aren't there."""
    monkeypatch.setattr(graph, "SENT", sent)
    rows = [(f"n{i % 7}", "R", f"n{i * i % 11}", "T", "T" if i % 2 else "U", f"s{i % 3}", None, None, None, 100 - i) for i in range(60)]
    every = spark.createDataFrame(rows, "subject string, relationship string, object string, subject_type string, object_type string, source string, page_number long, bbox array<double>, section string, seq long")
    ids = {"n1", "n9", "none"} if key == "name" else {"n1\x1fT", "n9\x1fU"}
    near = spark.createDataFrame([(i,) for i in ids for _ in range(2)] + [(None,)], "node string")
    got = graph.edges(graph.touching(every, near, key), key).collect()
    want = [r for r in graph.edges(every, key).collect() if r.src in ids or r.dst in ids]
    assert got and sorted(got) == sorted(want)


@pytest.mark.parametrize("sent", [0, 100])
def test_measured_readings_of_one_id_meet(spark, monkeypatch, sent):
    """By joins of either kind: what two readings of an id share comes once, and so does a repeated reading."""
    monkeypatch.setattr(extract, "TEXTS", sent)
    rows = spark.createDataFrame([(1, "R-5 and 7 ACH"), (1, "R-5"), (1, "R-5"), (2, "r-5"), (3, None), (3, "none"), (None, "R-5"), (None, "R-5, R-6")], "id long, text string")
    got = sorted(((r.id, r.object) for r in extract.measured(rows).collect()), key=repr)
    assert got == [(1, "7 ACH50"), (1, "R-5"), (2, "R-5"), (None, "R-5"), (None, "R-6")]


def test_measurements(spark):
    t = "10.1: 2,321 CFM's, R-20 r20 R20x 12 kPa; 35°C and 120 degrees F, 5 achievements, 2,321 cfm"
    got = spark.createDataFrame([(t,)], "t string").select(F.inline(extract.measurements(F.col("t")))).collect()
    assert [r.object for r in got] == ["2321 CFMs", "5 ACH50", "R-20", "12 Pa", "35", "120"]


def test_rich_parse(spark):
    good = {"entities": [{"entity_name": "A", "entity_type": "T", "entity_description": "d"}], "relationships": [{"source_entity": "A", "target_entity": "B", "relation": "r"}]}
    raw = spark.createDataFrame([(1, "x " + json.dumps(good) + " y"), (2, "none"), (3, "{bad"), (4, '{"entities":[{"entity_name":"A"}]}')], "chunk_id long, response string")
    entities, relationships = extract.parse_rich(raw)
    assert [r.entity_name for r in entities.collect()] == ["A"] and relationships.count() == 0


def test_expansion_equals_paths(spark):
    import itertools
    import random

    r = random.Random(5)
    edges = [(f"n{r.randrange(7)}", "E", f"n{r.randrange(7)}", i) for i in range(9)]
    frame = spark.createDataFrame([(a, f"{e}{i}", b, a, b, "s", None, None, None) for a, e, b, i in edges], "src string, relationship string, dst string, subject string, object string, source string, page_number long, bbox array<double>, section string")
    for hops in (1, 2, 3):
        got = {x.relationship for x in graph.expand(frame, spark.createDataFrame([(1, 1, "n0")], "query int, rank int, node string"), hops).collect()}
        want = set()
        for n in range(1, hops + 1):
            for path in itertools.permutations(edges, n):
                at = "n0"
                for a, _, b, _ in path:
                    at = b if at == a else a if at == b else None
                    if at is None:
                        break
                else:
                    want |= {f"E{e[3]}" for e in path}
        assert got == want
    with pytest.raises(ValueError):
        graph.expand(frame, spark.createDataFrame([(1, 1, "n0")], "query int, rank int, node string"), 0)


def test_keyword_search_words(spark):
    names = spark.createDataFrame([("The CEO",), ("Chief",), ("ceo?",)], "name string")
    asked = spark.createDataFrame([(1, "who is the ceo?"), (2, "is a"), (3, "CHIEF chief ceo")], "query int, question string")
    got = [(r.query, r["name"], r.hits) for r in rank.keyword_seeds(names, asked).orderBy("query", "rank").collect()]
    assert got == [(1, "ceo?", 1), (3, "Chief", 2), (3, "The CEO", 1), (3, "ceo?", 1)]


@pytest.mark.parametrize("n, kept", [(20, 20), (21, 20), (41, 20)])
def test_gate(spark, n, kept):
    facts = spark.range(n).select(F.lit(1).alias("query"), F.lit(1).alias("rank"), F.format_string("s%03d", "id").alias("subject"), F.lit("R").alias("relationship"), F.lit("o").alias("object"), F.lit("src").alias("source"), F.format_string("fact %d", "id").alias("fact_text"))
    asked = spark.createDataFrame([(1, "what about zz")], "query int, question string")
    got = rank.gated_rerank(rank.preranked(facts, asked), asked).collect()
    assert len(got) == kept and all((r.score is None) == (n <= 20) for r in got)
    assert rank.gated_rerank(rank.preranked(facts, asked), asked, None, max_facts=None).count() == min(n, 40 if n > 20 else n)


def test_citations_key(spark):
    rows = [(1, 1, "a", None, "x", None, None), (1, 2, "b", None, "y", None, None), (1, 3, "c", 0, "", None, None), (1, 4, "d", 2, "", [1.0, 2.0, 3.0, 4.0], "S"), (1, 5, "e", 2, "q", [1.0, 2.0, 3.0, 4.0], "S")]
    facts = spark.createDataFrame(rows, "query int, place int, fact_text string, page_number long, source string, bbox array<double>, section string")
    assert [r.fact_text for r in rank.citations(facts).orderBy("cite").collect()] == ["a", "d"]


def test_chunk_scores(spark):
    chunks = spark.createDataFrame([(str(i), t, "s", p, [x, (1 - x * x) ** 0.5]) for i, (t, p, x) in enumerate([("red lamp", 0, 1.0), ("blue", 3, 0.25), ("red", 4, 0.2)])], "chunk_id string, text string, source string, page_number long, embedding array<double>")
    asked = spark.createDataFrame([(1, "red lamp", [1.0, 0.0])], "query int, question string, embedding array<double>")
    got = rank.retrieve_chunks(chunks, asked).collect()
    assert [(r.chunk_id, r.page_number, r.score) for r in got] == [("0", None, 1.0)]
    assert rank.retrieve_chunks(chunks.filter("chunk_id = '1'"), asked).first().score == 0.25


def test_communities(spark):
    pairs = [(f"n{i:02}", f"n{j:02}") for b in (0, 8) for i in range(b, b + 8) for j in range(i + 1, b + 8)] + [("n00", "n08"), ("x", "y"), ("z", "z")]
    found = community.communities(spark.createDataFrame([(min(p), max(p), "r", "d") for p in pairs], "a string, b string, relationship string, description string"))
    rows = found.collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r.level, r.cluster), set()).add(r.node)
    assert {r.node for r in rows} == {n for p in pairs for n in p}
    assert {r.level for r in rows} == {0}  # nothing splits a clique, whatever its size
    assert {frozenset(v) for (level, _), v in sizes.items() if level == 0} == {frozenset(f"n{i:02}" for i in range(8)), frozenset(f"n{i:02}" for i in range(8, 16)), frozenset("xy"), frozenset("z")}


def _random_graph(seed, groups=5, size=14):
    import random

    r, pairs = random.Random(seed), set()
    for g in range(groups):
        for i in range(size):
            for j in range(i):
                if r.random() < 0.5:
                    pairs.add((f"g{g}n{j:02}", f"g{g}n{i:02}"))
        pairs.add((f"g{g}n00", f"g{(g + 1) % groups}n05") if g < groups - 1 else ("g0n01", f"g{g}n01"))
    pairs |= {("hub", f"leaf{i:02}") for i in range(17)} | {("p", "q"), ("z", "z")}
    return sorted({(min(p), max(p)) for p in pairs})


def test_joins_find_the_communities_of_one_task(spark, monkeypatch):
    """The constant decides where a group is computed, not what comes out."""
    pairs = _random_graph(3, 2, 6)
    frame = spark.createDataFrame(pairs, "a string, b string")
    monkeypatch.setattr(community, "ROUNDS", 2)
    alone = sorted(tuple(r) for r in community.communities(frame).collect())
    assert {r[0] for r in alone} == {n for p in pairs for n in p}
    monkeypatch.setattr(community, "LARGE", 20)
    assert sorted(tuple(r) for r in community.communities(frame).collect()) == alone


def test_guessed_sizes_do_not_grow_from_round_to_round(spark, monkeypatch):
    """The optimizer multiplies sizes at each join, and a checkpoint keeps its guess: the number itself would fill the driver."""
    bits = []

    def seen(df):
        bits.append(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length())
        return checkpoints.written(df)

    monkeypatch.setattr(community, "written", seen)
    monkeypatch.setattr(community, "LARGE", 20)
    monkeypatch.setattr(community, "ROUNDS", 4)
    community.communities(spark.createDataFrame(_random_graph(3, 2, 6), "a string, b string"))
    assert max(bits) < 400


def test_modularity_is_near_that_of_plain_moving():
    def modularity(pairs, parts):
        of, m = {n: i for i, part in enumerate(parts) for n in part}, len(pairs)
        degree = {}
        for a, b in pairs:
            for n in (a, b):
                degree[of[n]] = degree.get(of[n], 0) + 1
        return sum(of[a] == of[b] for a, b in pairs) / m - sum((d / (2 * m)) ** 2 for d in degree.values())

    def plain(names, pairs):
        of, moved = {n: i for i, n in enumerate(names)}, True
        near = {n: [b if a == n else a for a, b in pairs if n in (a, b)] for n in names}
        while moved:
            moved = False
            for n in names:
                def value(c):
                    return sum(of[m] == c for m in near[n]) - len(near[n]) * sum(len(near[m]) for m in names if of[m] == c and m != n) / (2 * len(pairs))

                best = max(sorted({of[m] for m in near[n]} | {of[n]}), key=lambda c: (value(c), c == of[n]))
                if best != of[n]:
                    of[n], moved = best, True
        return [[n for n in names if of[n] == c] for c in set(of.values())]

    for seed in range(4):
        pairs = [p for p in _random_graph(seed) if p[0] != p[1]]
        names = sorted({n for p in pairs for n in p})
        ours = community.local_moving(names, pairs)
        assert sorted(n for part in ours for n in part) == names
        assert modularity(pairs, ours) >= 0.97 * modularity(pairs, plain(names, pairs))


def test_refined_communities_are_connected_and_merge_inside():
    import numpy as np

    for seed in range(5):
        pairs = [p for p in _random_graph(seed) if p[0] != p[1]]
        names = sorted({n for p in pairs for n in p})
        number = {n: i for i, n in enumerate(names)}
        a, b = (np.array([number[p[i]] for p in pairs]) for i in (0, 1))
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        checks, k = np.arange(len(names)) * 7919, np.bincount(x, minlength=len(names))
        moved = community._moved(x, y, np.ones(len(x), np.int64), k, checks, np.arange(len(names)))
        part = community._refined(x, y, np.ones(len(x), np.int64), k, checks, moved)
        for p in set(part.tolist()):
            nodes = set(np.flatnonzero(part == p).tolist())
            assert len({moved[n] for n in nodes}) == 1 and min(nodes) == p
            seen, todo = set(), [p]
            while todo:
                if (n := todo.pop()) not in seen:
                    seen.add(n)
                    todo += [int(m) for m in y[x == n] if int(m) in nodes]
            assert seen == nodes
        for part_ in community.local_moving(names, pairs):
            inner = [p for p in pairs if p[0] in part_ and p[1] in part_]
            assert len(part_) == 1 or {n for p in inner for n in p} == set(part_)


def test_what_moves_do_not_split_stays_whole():
    star = [("hub", f"leaf{i:02}") for i in range(12)]
    names = sorted({n for p in star for n in p})
    assert community.hierarchy(names, star, 5) == [(n, 0, "hub/0") for n in names]


def test_a_large_cluster_is_named_once():
    """Names are compared in proportion to the nodes; they count their comparisons."""

    class Name(str):
        compared = 0

        def __lt__(self, other):
            Name.compared += 1
            return str.__lt__(self, other)

        __hash__ = str.__hash__

    names = [Name(f"leaf{i:04}") for i in range(1200)] + [Name("tub")]
    found = community.hierarchy(names, [(n, names[-1]) for n in names[:-1]], 5)
    assert sorted(found) == [(n, 0, "leaf0000/0") for n in names] and Name.compared < 20 * len(names)


def test_reduce(spark):
    asked = spark.createDataFrame([(i,) for i in range(4)], "query int")
    partial = spark.createDataFrame([(1, 1, "No information here"), (1, 2, "not available"), (2, 1, "No information"), (2, 2, "assistant: yes"), (3, 1, "a"), (3, 2, None), (3, 3, "b")], "query int, rank int, answer string")
    assert {r.query: r.answer for r in community.reduce_answers(asked, partial).collect()} == {0: community.NOTHING_FOUND, 1: "No information here", 2: "yes", 3: "a b"}


@pytest.mark.parametrize("n", [1, 2, 20, 40])
def test_percentiles(spark, n):
    values = sorted(float(i * 7 % n) for i in range(n))
    got = evaluation.latency(spark.createDataFrame([("b", v) for v in values], "backend string, latency_ms double")).first()
    at = lambda p: values[min(int(n * p), n - 1)]
    assert (got.n, got.least, got.p50, got.p95, got.most) == (n, values[0], at(0.5), at(0.95), values[-1])


def test_contexts(spark):
    got = spark.createDataFrame([("- a\n-  b\n\n",), ("",)], "t string").select(tx.split_facts(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["a", "b"], [tx.NO_CONTEXT]]


def test_merge_keeps_the_first_provenance(spark, business, tmp_path):
    root = str(tmp_path / "g")
    every = triples.business_triples(business).persist()
    assert merge.read_graph(spark, root) is None
    merge.merge_batch(spark, every.filter("relationship = 'IS_A'").withColumn("source", F.lit("first")), root)
    merge.merge_batch(spark, every.withColumn("source", F.lit("second")), root)
    nodes, edges = merge.read_graph(spark, root)
    assert {(r.relationship == "IS_A", r.source) for r in edges.collect()} == {(True, "first"), (False, "second")}
    assert edges.count() == every.count()
    assert nodes.count() == graph.nodes(every).count() == nodes.select("id").distinct().count()


def test_merge_survives_a_crash_and_a_replay(spark, business, tmp_path, monkeypatch):
    root = str(tmp_path / "g")
    rows = triples.unpivot(business["regions"], [triples.Rule(F.col("name"), "IS_A", F.lit("Region"))], F.monotonically_increasing_id())
    merge.merge_batch(spark, rows, root, batch=0)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(merge.graph, "edges", crash)
        with pytest.raises(RuntimeError):
            merge.merge_batch(spark, rows, root, batch=1)
    assert [r.n for r in merge.read_graph(spark, root)[1].collect()] == [1]
    for _ in range(3):
        merge.merge_batch(spark, rows, root, batch=1)
    assert [r.n for r in merge.read_graph(spark, root)[1].collect()] == [2]
    merge.merge_batch(spark, rows, root, batch=2)
    assert [r.n for r in merge.read_graph(spark, root)[1].collect()] == [3]
    assert len(list((tmp_path / "g" / "edges").iterdir())) == 2 and merge.clear_graph(spark, root) == ["nodes", "edges"]
    assert merge.read_graph(spark, root) is None


def test_merge_stream(spark, business, tmp_path):
    every = triples.business_triples(business)
    every.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
    merge.merge_stream(stream, str(tmp_path / "g"), str(tmp_path / "cp")).awaitTermination()
    assert merge.read_graph(spark, str(tmp_path / "g"))[1].count() == spark.read.parquet(str(tmp_path / "in")).count()


def test_service(spark, business, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(api.BadRequest):
        api.Service(spark, root).ask("who")
    merge.merge_batch(spark, triples.business_triples(business), root)
    readers.write_chunks(triples.linearise(business["products"], "products").select("text", F.lit("products").alias("source"), F.lit(None).cast("long").alias("page_number")), f"{root}/chunks")
    s = api.Service(spark, root, count_tokens=len)
    s.store_vectors()
    with s:
        got = s.ask("who did bob report to", 1)
        assert "Bob REPORTS TO Ann" in got["answer"] or got["citations"]
        assert set(got["latency"]) == {"embed_ms", "seeds_ms", "facts_ms", "answer_ms", "total_ms"} and got["tokens"]["answer"] == len(got["answer"])
        assert set(s.ask_both("lamp", 1)) == {"query", "graph", "chunks"}
        with pytest.raises(api.BadRequest):
            s.ask("  ")
    assert s.delete_graph() == {"deleted": ["nodes", "edges"]} and s.health() == {"status": "ok"}


def test_facts_met_as_numbers_equal_facts_met_as_rows(spark):
    """Edges of one fact that differ in their ends' types, nulls in several places, ties of provenance, several ranks, a struct as query."""
    import random

    r, rows = random.Random(11), []
    for i in range(160):
        a, b = (r.choice(["a", "b", "c", None]) for _ in range(2))
        rows.append((f"{a}/{r.randrange(3)}", r.choice(["R", "S_T"]), f"{b}/{r.randrange(3)}", a, b, r.choice(["x", "y", None]), r.choice([None, 0, 3]), None, r.choice([None, "z"])))
    rows = list({x[:3]: x for x in rows}.values())
    rows += [("n/0", "R", "m/0", None, "m", "x", None, [1.0], None), ("m/0", "R", "n/0", "m", None, "x", None, None, None)]
    edges = spark.createDataFrame(rows, "src string, relationship string, dst string, subject string, object string, source string, page_number long, bbox array<double>, section string")
    seeds = spark.createDataFrame([(q, k, n) for q in (1, 2, None) for k, n in ((0, "a/0"), (3, "b/1"), (1, "n/0"), (2, "a/0"))], "query long, rank int, node string").withColumn("query", F.struct(F.lit("s").alias("s"), "query"))
    for hops in (1, 2):
        got, want = graph.facts(edges, seeds, hops), graph.facts(edges, seeds, hops, first=lambda rows: rows)
        assert got.schema["rank"].dataType == seeds.schema["rank"].dataType
        columns = ["query", "rank", "subject", "relationship", "object", "source", "page_number", "bbox", "section", "fact_text"]
        listed = lambda df: sorted(map(repr, df.select(*columns).collect()))
        assert listed(got) == listed(want) and got.count() > 20
    assert graph.facts(edges.limit(0), seeds, 2).count() == 0 == graph.facts(edges, seeds.limit(0), 2).count()


@pytest.mark.parametrize("some", [0, 1, 100])
def test_facts_of_two_hops_are_not_shuffled(spark, monkeypatch, some):
    """Whichever ends many questions reach, facts are those that met as rows; only edges between two such ends are dealt by question."""
    import random

    r, rows = random.Random(3), set()
    for i in range(60):
        rows |= {(f"a{i}", "R", f"b{r.randrange(40)}"), (f"b{r.randrange(40)}", "S_T", f"a{i}"), (f"a{i}", "OF", "hub"), (f"a{r.randrange(60)}", "R", f"a{i}")}
    edges = spark.createDataFrame([(s, p, o, s, o, "x", None, None, None) for s, p, o in rows], "src string, relationship string, dst string, subject string, object string, source string, page_number long, bbox array<double>, section string")
    seeds = spark.createDataFrame([(q, k, n) for q in range(9) for k, n in ((0, f"a{q * 5}"), (2, f"b{q}"), (1, "hub" if q < 4 else "a3"))], "query int, rank int, node string")
    monkeypatch.setattr(graph, "SOME", some)
    monkeypatch.setattr(graph, "GIVEN", 50)
    want = graph.facts(edges, seeds, 2, first=lambda rows: rows)
    got = graph.facts(edges, seeds, 2)
    assert sorted(map(repr, got.select(sorted(want.columns)).collect())) == sorted(map(repr, want.select(sorted(want.columns)).collect()))
    dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(f1" in line or "hashpartitioning(query" in line]
    assert all("src" in line for line in dealt) and len(dealt) <= 1


def test_facts_are_counted_as_they_are_gathered(spark):
    """Texts of several edges and of several seeds count once; a struct as query, seeds that lead nowhere."""
    import random

    r, rows = random.Random(7), set()
    for _ in range(120):
        a, b = (r.choice("abcde") for _ in range(2))
        rows.add((f"{a}/{r.randrange(2)}", r.choice(["R_S", "R S", "T"]), f"{b}/{r.randrange(2)}", a, b))
    rows.add(("loop", "R", "loop", "loop", "loop"))
    edges = spark.createDataFrame(list(rows), "src string, relationship string, dst string, subject string, object string")
    seeds = spark.createDataFrame([(q, k, n) for q in range(12) for k, n in enumerate(r.sample(["a/0", "a/1", "b/0", "c/1", "d/0", "loop", "nobody", None], 4))], "query int, rank int, node string")
    seeds = seeds.withColumn("query", F.struct(F.lit("s").alias("s"), "query"))
    want = {r["query"]["query"]: len(r["facts"]) for r in graph.facts_text(edges, seeds, 1).collect()}
    assert {r["query"]["query"]: r["facts"] for r in graph.facts_count(edges, seeds).collect()} == want and len(set(want.values())) > 3


def test_starts_keep_what_any_question_has_among_its_first(spark):
    """Questions share a hub that they reach with several ranks; the first facts are those of all rows, and few rows meet the questions."""
    import random

    r, rows, k = random.Random(5), {}, 6
    for i in range(400):
        a, b = (f"{r.choice(['lamp', 'desk', 'mat'])} {r.randrange(60)}" for _ in range(2))
        for s, o, rel in ((a, b, r.choice(["MADE_OF", "NEAR"])), ("hub", a, "HAS"), ("hub", b, "HAS")):
            rows[s, rel, o] = (s, rel, o, s, o, r.choice(["x", None]), r.choice([None, 1]), None, None)
    edges = spark.createDataFrame(list(rows.values()), "src string, relationship string, dst string, subject string, object string, source string, page_number long, bbox array<double>, section string")
    questions = spark.createDataFrame([(q, r.choice(["which Lamp is near", "made of desk", "hub has mat", "", None, "lamp lamp desk"])) for q in range(30)], "query int, question string")
    seeds = spark.createDataFrame([(q, i + 1, n) for q in range(30) for i, n in enumerate(r.sample(["hub", "lamp 1", "desk 2", "mat 3", "nobody", None], 3))], "query int, rank int, node string")
    held = rank.with_held(edges, questions)
    for hops in (1, 2):
        first = lambda rows: rank.first_facts(rows, questions, k, 3)
        want, got = (rank.preranked(f, questions).filter(F.col("place") <= k).drop("bbox") for f in (graph.facts(edges, seeds, hops, None, first), graph.facts(held, seeds, hops, None, first, rank.first_of_starts(k))))
        listed = lambda df: sorted(map(repr, df.select(sorted(want.columns)).collect()))
        assert listed(got) == listed(want) and got.count() > 100
    met = graph._from_starts(held, seeds, 2, None, rank.first_of_starts(k)).groupBy("query").count().agg(F.max("count")).first()[0]
    assert met * 2 < graph._reached(edges, seeds, 2, None).groupBy("query").count().agg(F.max("count")).first()[0]


def test_a_nodes_edges_are_left_out_before_its_starts_meet_them(spark, monkeypatch):
    """Common words are bits and rare ones meet their own questions alone; the first facts are those of all rows, and a hub gives a start few of its edges."""
    import random

    r, rows, k = random.Random(9), {}, 4
    for i in range(200):
        a = f"part#{i}"
        for s, o, rel in ((a, "hub", "ORDERED"), (f"buyer {r.randrange(30)}", a, "BOUGHT"), (a, f"kind {r.randrange(3)}", "IS_A")):
            rows[s, rel, o] = (s, rel, o, s, o, "x", None, None, None)
    edges = spark.createDataFrame(list(rows.values()), "src string, relationship string, dst string, subject string, object string, source string, page_number long, bbox array<double>, section string")
    questions = spark.createDataFrame([(q, f"which buyer bought PART#{q * 7} or is a") for q in range(25)], "query int, question string")
    seeds = spark.createDataFrame([(q, i + 1, n) for q in range(25) for i, n in enumerate((f"part#{q * 7}", "buyer 3"))], "query int, rank int, node string")
    monkeypatch.setattr(rank, "COMMON", 3)
    held = rank.with_held(edges, questions)
    bits, rare = zip(*((x["_mask"], x["_rare"]) for x in held.filter("object = 'hub' and subject = 'part#70'").collect()))
    assert bits[0] < 8 and "part#70" in rare[0] and "part#7" in rare[0]
    first = lambda rows: rank.first_facts(rows, questions, k, 2)
    want, got = (rank.preranked(f, questions).filter(F.col("place") <= k).drop("bbox") for f in (graph.facts(edges, seeds, 2, None, first), graph.facts(held, seeds, 2, None, first, rank.first_of_starts(k, questions))))
    assert sorted(map(repr, got.select(sorted(want.columns)).collect())) == sorted(map(repr, want.select(sorted(want.columns)).collect()))
    met = graph._from_starts(held, seeds, 2, None, rank.first_of_starts(k, questions)).filter("dst = 'hub'").groupBy("query", "rank").count().agg(F.max("count")).first()[0]
    assert met <= 60  # of 200


def test_lookup_of_ids_known_to_be_unique(spark):
    rows = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "n int, k int")
    names = spark.createDataFrame([(7, "seven"), (8, None), (None, "none")], "id int, name string")
    found = [sorted((x.n, x.out) for x in triples.lookup(rows, "k", names, "out", unique).collect()) for unique in (False, True)]
    assert found[0] == found[1] == [(1, "seven"), (2, ""), (3, "")]


def test_edges_by_name_carry_their_ends(spark):
    every = spark.createDataFrame([("a", "is a", "b", "s2", 2), ("a", "IS_A\n", "b", "s1", 1), ("a", "ISA", "b", "s0", 3), (" é", "--", "b", "s", 4)], "subject string, relationship string, object string, source string, seq long")
    every = every.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("subject_type", "string"), ("object_type", "string"), ("page_number", "long"), ("bbox", "array<double>"), ("section", "string"))])
    got = sorted((x.src, x.relationship, x.dst, x.subject, x.object, x.source, x.n) for x in graph.edges(every, "name").collect())
    assert got == [(" é", "RELATED_TO", "b", " é", "b", "s", 1), ("a", "ISA", "b", "a", "b", "s2", 2), ("a", "IS_A", "b", "a", "b", "s1", 1)]


def test_lane_without_facts(spark, business):
    every = triples.business_triples(business)
    asked = spark.createDataFrame([(1, "qqqq")], "query long, question string")
    got = lanes.graph_lane(graph.edges(every), graph.nodes(every), asked, strategy="word_only").first()
    assert got.context == "" and got.answer == "No relevant information found."


def test_models_and_keys(spark):
    class Model:
        def __call__(self, prompts):
            if "bad" in prompts:
                raise RuntimeError
            return [f"assistant: {p}!" for p in prompts]

    rows = spark.createDataFrame([("a",), ("bad",)], "p string").repartition(2)
    assert {r.p: r.out for r in protocols.apply_model(rows, "p", "out", Model, batch=1).collect()} == {"a": "a!", "bad": None}
    keys = protocols.KeyRotation(readers.load_keys("k1\n\n k2 \n"))

    def client(key):
        if key == "k1":
            raise protocols.RateLimited
        return key

    assert keys.call(client) == "k2" and keys.current == "k2"
    with pytest.raises(protocols.RateLimited):
        protocols.KeyRotation(["k1"]).call(client)
    with pytest.raises(ValueError):
        readers.load_keys(" \n")


def test_types_are_made_labels_after_ends_meet(spark):
    """By name the plan's regular expression lies in or over the aggregate of the ends, and types that give one label are one node."""
    rows = [("a", "R", "b", "My Type", None, 2), ("b", "R", "a", "Entity", "My-Type", 1), ("a", "R", "c", "MyType", "x", 3)]
    t = spark.createDataFrame(rows, "subject string, relationship string, object string, subject_type string, object_type string, seq long")
    found = graph.nodes(t, "name_type")
    assert sorted((r["name"], r["type"]) for r in found.collect()) == [("a", "MyType"), ("b", "Entity"), ("c", "x")]
    by_name = graph.nodes(t, "name")
    plan = by_name._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in plan[plan.rindex("+- Generate") :]
    assert sorted((r["name"], r["type"]) for r in by_name.collect()) == [("a", "MyType"), ("b", "Entity"), ("c", "x")]


def test_strip_at_seen_and_unseen_ends(spark):
    cases = ["", " ", "a", " a", "a ", "a b", " é ", "é", "é ", "\ta\x0b", "~", "\x7f", "!", "a　", "\x1ca\x1c"]
    got = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string").sort("i").select(tx.strip(F.col("v")).alias("x")).collect()]
    blank = " \t\n\x0b\f\r  　"
    assert got == [v.strip(blank) for v in cases]


@pytest.mark.parametrize("key", ["name", "name_type"])
def test_writes_meet_stored_edges_in_one_aggregate(spark, key):
    """Edges that are there keep provenance and are counted on, null keys too; new writes aren't merged by themselves before."""
    kinds = "subject string, relationship string, object string, subject_type string, object_type string, source string, page_number long, bbox array<double>, section string, seq long"
    rows = lambda source, *ids: spark.createDataFrame([(f"s{i % 4}", None if i == 2 else "R", f"o{i % 3}", "T", None, source, i, [0.5], None, 9 - i) for i in ids], kinds)
    one = graph.edges(rows("one", 1, 2, 3, 13), key)
    found = graph.edges(rows("two", 1, 2, 4, 5, 17), key, one)
    got = {(r.subject, r.relationship, r.object): (r.source, r.page_number, r.bbox, r.n) for r in found.collect()}
    assert got == {
        ("s1", "R", "o1"): ("one", 13, [0.5], 3), ("s2", None, "o2"): ("one", 2, [0.5], 2), ("s3", "R", "o0"): ("one", 3, [0.5], 1),
        ("s0", "R", "o1"): ("two", 4, [0.5], 1), ("s1", "R", "o2"): ("two", 17, [0.5], 2),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2 and found.columns == one.columns
