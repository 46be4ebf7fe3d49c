"""The property graph as two tables: upserts that merge, and expansion by frontier joins.

A node's id is its name, or name and type; edges hold the ids of both ends with their provenance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.functions.text import label
from graphloom.functions.text import relationship as clean_relationship
from graphloom.operators.triples import first_of

PROVENANCE = ("source", "page_number", "bbox", "section")


def node_id(name: Column, kind: Column, key: str) -> Column:
    if key not in ("name", "name_type"):
        raise ValueError("key is name or name_type")
    return name if key == "name" else F.concat_ws("\x1f", name, kind)


def _ends(triples: DataFrame) -> DataFrame:
    """name, type, seq of the triples' ends, the least seq for each type as it is given; only then is that made a label."""
    ends = triples.select(F.inline(F.array(*(F.struct(F.col(end).alias("name"), F.col(f"{end}_type").alias("kind"), "seq") for end in ("subject", "object")))))
    met = ends.groupBy("name", "kind").agg(F.min("seq").alias("seq"))
    return met.select("name", label(F.coalesce("kind", F.lit("Entity"))).alias("type"), "seq")


def nodes(triples: DataFrame, key: str = "name_type", existing: DataFrame | None = None) -> DataFrame:
    """id, name, type. By name, a node has the type that it had first (smallest type among ties).

    existing: nodes that are there already; the new ones alone are added.
    """
    ends = _ends(triples)
    found = ends.select("name", "type").distinct() if key == "name_type" else first_of(ends, ("name",), "seq", "type")
    found = found.select(node_id(F.col("name"), F.col("type"), key).alias("id"), "name", "type")
    return found if existing is None else existing.unionByName(found.join(existing.select("id"), "id", "left_anti"))


def edges(triples: DataFrame, key: str = "name_type", existing: DataFrame | None = None, by: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """src, relationship, dst, subject, object, source, page_number, bbox, section, n: one row per edge.

    The provenance is that of the first write by seq; edges of `existing` keep theirs, and counts add up.
    by: columns made from the edge's hash, by which rows are dealt and sorted before it; they stay in the result.
    """
    return _merged(writes(triples, key, existing), key, by)


def _carried(key: str) -> tuple[str, ...]:
    """Where ids are names, they aren't carried twice."""
    return PROVENANCE if key == "name" else (*PROVENANCE, "subject", "object")


def writes(triples: DataFrame, key: str = "name_type", existing: DataFrame | None = None) -> DataFrame:
    """The triples as edges of one write each, and the edges of `existing`, which come before."""
    t = triples.select(
        node_id(F.col("subject"), label(F.coalesce("subject_type", F.lit("Entity"))), key).alias("src"), clean_relationship(F.col("relationship")).alias("relationship"), node_id(F.col("object"), label(F.coalesce("object_type", F.lit("Entity"))), key).alias("dst"), *_carried(key), "seq"
    )
    if existing is None:
        return t
    old = existing.select("src", "relationship", "dst", *_carried(key), F.lit(None).cast(triples.schema["seq"].dataType).alias("seq"), F.lit(0).alias("_new"), "n")
    return old.unionByName(t.withColumn("_new", F.lit(1)).withColumn("n", F.lit(1).cast("long")))


def _merged(writes_: DataFrame, key: str, by: Callable[[Column], dict[str, Column]] | None) -> DataFrame:
    """One row per edge of writes(...), in one shuffle and one sort."""
    hash_ = F.xxhash64("src", "relationship", "dst")
    by, old = {} if by is None else by(hash_), "_new" in writes_.columns
    first = F.min(F.struct(*(["_new"] if old else []), "seq", *_carried(key))).alias("p")
    # the hash leads the sort of this aggregate, so that texts are compared only where it is equal; dealt by it first, rows are sorted
    # once, in parts of their own size, and not in the joins' tasks, whose size goes by the keys that they read
    # the hash, as long as all else that doesn't compress, is made again behind the shuffle
    dealt = writes_.repartition(*(by.values() or [hash_])).withColumns({"_hash": hash_, **by})
    found = dealt.groupBy(*by, "_hash", "src", "relationship", "dst").agg(first, (F.sum("n") if old else F.count("*")).alias("n"))
    ends = [F.col("src").alias("subject"), F.col("dst").alias("object")] if key == "name" else ["p.subject", "p.object"]
    return found.select("src", "relationship", "dst", *ends, *(f"p.{name}" for name in PROVENANCE), "n", *by)


#: Nodes that are sent to all triples; beyond it both are shuffled.
SENT = 200_000


def touching(triples: DataFrame, nodes_: DataFrame, key: str = "name_type") -> DataFrame:
    """The triples with an end among nodes_ (node, an id), all that edges of those nodes are merged from.

    An edge's triples share its ends, so that its count and provenance are as in the whole graph, of
    which the rest is neither shuffled nor merged.
    """
    one = cut(nodes_.select("node").filter("node is not null").distinct())
    sent = F.broadcast if one.count() <= SENT else lambda rows: rows
    found = triples
    for name in ("subject", "object"):
        end = node_id(F.col(name), label(F.coalesce(f"{name}_type", F.lit("Entity"))), key)
        found = found.join(sent(one.select(F.col("node").alias(f"_{name}"))), end == F.col(f"_{name}"), "left")
    return found.filter("_subject is not null or _object is not null").drop("_subject", "_object")


def triplets(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """src, src_name, src_type, relationship, dst, dst_name, dst_type and provenance of every stored edge whose ends are nodes."""
    end = lambda x: nodes_.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name"), F.col("type").alias(f"{x}_type"))
    found = edges_.select("src", "relationship", "dst", *PROVENANCE).join(end("src"), "src").join(end("dst"), "dst")
    return found.select("src", "src_name", "src_type", "relationship", "dst", "dst_name", "dst_type", *PROVENANCE)


def typed_edges(*triples: DataFrame) -> DataFrame:
    """src, src_name, src_type, relationship, dst, dst_name, dst_type and provenance, as triplets(nodes, edges) of these triples by name.

    A node with one type has it in each of its triples, so an edge carries the types of the triple that
    it stems from; only the nodes of several types, few as a rule, are looked up. Triples may come in
    several tables that share no relationship, and so no edge; those with a column _by, by which they are
    dealt, are merged where they lie.
    """
    kind, found = lambda end: label(F.coalesce(f"{end}_type", F.lit("Entity"))), None
    for some in triples:
        by = [x for x in ("_by",) if x in some.columns]
        t = some.select(F.col("subject").alias("src"), clean_relationship(F.col("relationship")).alias("relationship"), F.col("object").alias("dst"), kind("subject").alias("src_type"), kind("object").alias("dst_type"), *PROVENANCE, "seq", *by)
        t = t.withColumn("_hash", F.xxhash64("src", "relationship", "dst"))
        met = (t if by else t.repartition("_hash")).groupBy(*by, "_hash", "src", "relationship", "dst")
        one = met.agg(F.min(F.struct("seq", *PROVENANCE, "src_type", "dst_type")).alias("p")).select("src", "relationship", "dst", "p.*").drop("seq")
        found = one if found is None else found.unionByName(one)
    pairs = [x.select("subject", "subject_type", "object", "object_type", "seq") for x in triples]
    ends = _ends(reduce(DataFrame.unionByName, pairs)).groupBy("name", "type").agg(F.min("seq").alias("seq"))
    many = ends.groupBy("name").agg(F.count("*").alias("n"), F.min_by("type", F.struct("seq", "type")).alias("first")).filter("n > 1")
    many = cut(many.select("name", "first"))
    sent = F.broadcast if many.count() <= SENT else lambda rows: rows
    for end in ("src", "dst"):
        found = found.join(sent(many.select(F.col("name").alias(f"_{end}"), F.col("first").alias(f"_{end}_first"))), F.col(end) == F.col(f"_{end}"), "left")
    first = lambda end: F.coalesce(f"_{end}_first", f"{end}_type").alias(f"{end}_type")
    return found.select("src", F.col("src").alias("src_name"), first("src"), "relationship", "dst", F.col("dst").alias("dst_name"), first("dst"), *PROVENANCE)


#: An end with more edges than this is a hub, whose edges lie in several parts.
HUB = 100_000
#: Edges of one fact, which differ in their ends' types alone, are fewer.
PLACES = 1 << 32


def hubs(edges_: DataFrame, most: int = HUB) -> DataFrame:
    """node, parts of the nodes with over `most` edges: a small table, to be stored beside the edges."""
    ends = edges_.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("node", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def _meet(near: DataFrame, edges_: DataFrame, end: str, other: str, hubs_: DataFrame | None) -> DataFrame:
    """near (query, rank, node) with the edges whose `end` is the node; a hub's edges are dealt by their other end over its parts, to each of which its rows of near go."""
    if hubs_ is None:
        return near.join(edges_, F.col("node") == F.col(end)).drop("node")
    parts = F.coalesce("parts", F.lit(1))
    dealt = edges_.join(hubs_.withColumnRenamed("node", end), end, "left").withColumn("_part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
    asked = near.join(hubs_, "node", "left").withColumn("_of", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return asked.join(dealt, (F.col("node") == F.col(end)) & (F.col("_of") == F.col("_part"))).drop("node", "_of", "_part")


def _frontier(edges_: DataFrame, near: DataFrame, hops: int, keep, hubs_: DataFrame | None) -> DataFrame:
    """near (query, rank, node) with all nodes within hops - 1 edges; keep reduces the rows of each level."""
    if hops < 1:
        raise ValueError("hops is at least 1")
    near, links = keep(near), edges_.select("src", "dst")
    for _ in range(hops - 1):
        out = _meet(near, links, "src", "dst", hubs_).select("query", "rank", F.col("dst").alias("node"))
        back = _meet(near, links, "dst", "src", hubs_).select("query", "rank", F.col("src").alias("node"))
        near = keep(near.select("query", "rank", "node").unionByName(out).unionByName(back))
    return near


def _touched(edges_: DataFrame, near: DataFrame, hubs_: DataFrame | None) -> DataFrame:
    """query, rank and the edge's own columns of the edges with an end in near; those with both ends there come twice."""
    return _meet(near, edges_, "src", "dst", hubs_).unionByName(_meet(near, edges_.filter("src <> dst"), "dst", "src", hubs_))


def expand(edges_: DataFrame, seeds: DataFrame, hops: int = 2, hubs_: DataFrame | None = None) -> DataFrame:
    """Facts within `hops` of each seed: seeds' columns query, rank and the edge's own.

    seeds: query, rank, node (an edge end's id). An edge lies on a path of up to `hops` edges that
    starts at a node exactly if one of its ends is at most hops - 1 edges away; so the frontier
    is widened node by node, distinct at every level, and paths are never enumerated. Edges keep
    their direction in the result, whichever way they were walked. A small frontier is sent to the
    edges as they are. Where both sides are shuffled, hubs_, the stored table of the hubs, deals
    a hub's edges over several tasks; without it that is left to adaptive execution.
    """
    near = _frontier(edges_, seeds.select("query", "rank", "node"), hops, lambda rows: rows.distinct(), hubs_)
    return _touched(edges_, near, hubs_).dropDuplicates(["query", "rank", "src", "relationship", "dst"])


def fact_text(e: DataFrame) -> DataFrame:
    return e.withColumn("fact_text", F.concat_ws(" ", "subject", F.replace(F.col("relationship"), F.lit("_"), F.lit(" ")), "object"))


def _reached(edges_: DataFrame, seeds: DataFrame, hops: int, hubs_: DataFrame | None) -> DataFrame:
    """As expand, but an edge comes with the least rank of the seeds that reach either end, once for each such end."""
    least = lambda rows: rows.groupBy("query", "node").agg(F.min("rank").alias("rank"))
    return _touched(edges_, _frontier(edges_, seeds.select("query", "rank", "node"), hops, least, hubs_), hubs_)


def _numbered(edges_: DataFrame) -> DataFrame:
    """edges_ with f1 and f2, two hashes of subject, relationship and object, _at, the edge's place among those of one fact, and _of, how many these are."""
    names = ("subject", "relationship", "object")
    marked = [x for name in names for x in (F.col(name), F.isnull(name))]  # a null alone leaves a hash as it was
    order = (F.coalesce("source", F.lit("")), F.coalesce("page_number", F.lit(-1)), "src", "dst")
    fact = Window.partitionBy("f1", "f2", *names)
    hashed = edges_.withColumn("f1", F.xxhash64(*marked)).withColumn("f2", F.xxhash64(F.lit(1), *marked))
    return hashed.withColumn("_at", F.row_number().over(fact.orderBy(*order)).cast("long")).withColumn("_of", F.count("*").over(fact))


#: A node that more questions reach than this is met last; and about as many rows as a part of such a node's edges gives.
SOME, GIVEN = 32, 4_000_000


def _met_in_place(edges_: DataFrame, near: DataFrame) -> DataFrame:
    """rank, query and edges_' own columns: an edge once for each query with an end in near (query, node, rank), with its least rank.

    A node's questions lie in one array. An edge first meets those of its ends that few questions reach,
    then, dealt by it, those of an end that many reach; it becomes a row a question in the task where both
    are known, so that nothing as large as questions times edges is shuffled. Edges between two nodes
    that many questions reach are left to an aggregate.
    """
    here = near.filter("node is not null")
    sets = here.groupBy("node").agg(F.collect_list(F.struct("query", "rank", F.lit(False).alias("again"))).alias("asked"), F.count("*").alias("n"))
    degree = edges_.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("edges"))
    sets = cut(sets.join(degree, "node").select("node", "asked", "n", F.ceil(F.col("n") * F.col("edges") / GIVEN).cast("int").alias("parts")))
    few, many = sets.filter(F.col("n") <= SOME), sets.filter(F.col("n") > SOME)
    sent = F.broadcast if many.count() <= SENT else lambda rows: rows
    found = edges_
    for end in ("src", "dst"):
        found = found.join(sent(many.select(F.col("node").alias(end), F.col("parts").alias(f"_{end}_parts"))), end, "left")
    both = found.filter("_src_parts is not null and _dst_parts is not null").select(*edges_.columns)
    found = found.filter("_src_parts is null or _dst_parts is null")
    for end in ("src", "dst"):
        found = found.join(few.select(F.col("node").alias(end), F.col("asked").alias(f"_{end}")), end, "left")
    found = found.filter("_src is not null or _dst is not null or _src_parts is not null or _dst_parts is not null")
    # an end that many reach has no other array; edges without such an end are dealt evenly
    node = F.when(F.col("_dst_parts").isNotNull(), F.col("dst")).when(F.col("_src_parts").isNotNull(), F.col("src"))
    part = F.pmod(F.xxhash64("src", "relationship", "dst"), F.coalesce("_dst_parts", "_src_parts", F.lit(1000))).cast("int")
    found = found.withColumn("_node", node).withColumn("_part", part)
    dealt = many.select(F.col("node").alias("_node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"), F.col("asked").alias("_many"))
    found = found.join(dealt, ["_node", "_part"], "left")
    most = F.coalesce("_many", "_dst", "_src")
    least = F.when(F.col("_many").isNotNull(), F.coalesce("_dst", "_src")).when(F.col("_dst").isNotNull(), F.col("_src"))
    found = found.select(*edges_.columns, most.alias("_most"), least.alias("_least"))
    better = F.transform("_least", lambda x: F.struct(x["query"].alias("query"), F.least(x["rank"], F.get(F.col("_most.rank"), (F.array_position("_most.query", x["query"]) - 1).cast("int"))).alias("rank"), F.lit(True).alias("again")))
    given = F.when(F.col("_least").isNull(), F.col("_most")).otherwise(F.concat("_most", better))
    found = found.select(*edges_.columns, F.col("_least.query").alias("_told"), F.explode(given).alias("_a"))
    found = found.filter(F.col("_a.again") | F.col("_told").isNull() | ~F.array_contains("_told", F.col("_a.query")))
    own = [F.col(c) for c in edges_.columns]
    rest = _touched(both, here, None).groupBy("query", "src", "relationship", "dst").agg(F.min("rank").alias("rank"), *(F.first(c).alias(c) for c in edges_.columns if c not in ("src", "relationship", "dst")))
    return found.select("_a.rank", "_a.query", *own).unionByName(rest.select("rank", "query", *own))


def _from_starts(edges_: DataFrame, seeds: DataFrame, hops: int, hubs_: DataFrame | None, of_start: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """As _reached, of what of_start (edges_, near, seeds) leaves of the edges (start, and the edge's own columns) that each distinct node of seeds reaches; an edge comes with each such seed's rank.

    near: start, node, all nodes within hops - 1 edges of each start.
    """
    starts = seeds.select("node").filter("node is not null").distinct().select(F.col("node").alias("query"), F.lit(0).alias("rank"), "node")
    near = cut(_frontier(edges_, starts, hops, lambda rows: rows.distinct(), hubs_).select(F.col("query").alias("start"), "node"))
    kept = of_start(edges_, near, seeds)
    return seeds.select("query", "rank", "node").join(kept, F.col("node") == F.col("start")).drop("node", "start")


def facts(edges_: DataFrame, seeds: DataFrame, hops: int = 2, hubs_: DataFrame | None = None, first: Callable[[DataFrame], DataFrame] | None = None, of_start: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """query, rank, subject, relationship, object, provenance, fact_text: once per query, of the first seed that reaches it.

    first: leaves out rows of facts that won't be asked for, before equal facts meet. of_start: leaves out
    edges that no question which starts at a node asks for, so that what a node reaches is made once
    for all its questions. Without first, and beyond one hop, where questions reach most edges, a fact of one
    edge is made where its edge meets the questions of its ends, and isn't shuffled. Facts of several edges,
    which differ in their ends' types, meet as numbers, a rank and an edge's place in one long, and the
    texts are joined to what stays. Ranks are whole numbers from 0.
    """
    if first is None and hops > 1:
        rank = dict(seeds.dtypes)["rank"]
        columns = ("query", "subject", "relationship", "object", "rank", *PROVENANCE, "fact_text")
        near = cut(_frontier(edges_, seeds.select("query", "rank", "node"), hops, lambda rows: rows.groupBy("query", "node").agg(F.min("rank").alias("rank")), hubs_))
        if edges_.filter("not (src <=> subject and dst <=> object)").isEmpty():  # ids are names, and a fact has one edge
            return _met_in_place(fact_text(edges_), near).select(*columns)
        numbered = cut(_numbered(edges_))
        lone = _met_in_place(fact_text(numbered.filter("_of = 1").drop("f1", "f2", "_at", "_of")), near)
        several = numbered.filter("_of > 1").drop("_of")
        # dealt by the fact alone, which serves the aggregate and the join, and no fact has more rows than questions have ends
        found = _touched(several.select("src", "dst", "f1", "f2", "_at"), near, hubs_).repartition("f1", "f2")
        best = F.min(F.col("rank").cast("long") * PLACES + F.col("_at")).alias("_best")
        one = found.groupBy("query", "f1", "f2").agg(best).join(several, ["f1", "f2"]).filter(F.col("_at") == F.col("_best") % PLACES)
        one = one.select("query", "subject", "relationship", "object", F.expr(f"_best div {PLACES}").cast(rank).alias("rank"), *PROVENANCE)
        return lone.select(*columns).unionByName(fact_text(one))
    found = fact_text(_reached(edges_, seeds, hops, hubs_) if of_start is None else _from_starts(edges_, seeds, hops, hubs_, of_start))
    found = found if first is None else first(found)
    order = F.struct("rank", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("page_number", F.lit(-1)).alias("p"), "src", "dst")
    one = found.groupBy("query", "subject", "relationship", "object").agg(F.min_by(F.struct("rank", *PROVENANCE), order).alias("p")).select("query", "subject", "relationship", "object", "p.*")
    return fact_text(one)


def facts_text(edges_: DataFrame, seeds: DataFrame, hops: int = 2, hubs_: DataFrame | None = None) -> DataFrame:
    """query, facts: the sorted distinct texts of what seeds reach."""
    found = fact_text(_reached(edges_, seeds, hops, hubs_)).select("query", "fact_text").distinct()
    return found.groupBy("query").agg(F.sort_array(F.collect_list("fact_text")).alias("facts"))


def facts_count(edges_: DataFrame, seeds: DataFrame) -> DataFrame:
    """query, facts: how many distinct texts facts_text finds within one hop; queries without any are left out.

    A seed's texts are counted once, whatever questions have it. A question's are the sum over its seeds,
    less what it has by two or more of them: only texts that hold several seeds meet questions.
    """
    near = cut(seeds.select("query", "node").filter("node is not null").distinct())
    texts = fact_text(edges_).select("fact_text", F.explode(F.array("src", "dst")).alias("node"))
    held = cut(texts.join(near.select("node").distinct(), "node", "left_semi").distinct())
    every = near.join(held.groupBy("node").agg(F.count("*").alias("n")), "node").groupBy("query").agg(F.sum("n").alias("n"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("pair")
    several = held.groupBy("fact_text").agg(F.collect_set("node").alias("m")).filter("size(m) > 1").select("fact_text", F.explode("m").alias("a"), "m")
    several = several.select("fact_text", "a", F.explode("m").alias("b")).filter("a < b").select("fact_text", pair("a", "b"))
    asked = near.withColumnRenamed("node", "a").join(near.withColumnRenamed("node", "b"), "query").filter("a < b").select("query", pair("a", "b"))
    met = asked.join(several, "pair").groupBy("query", "fact_text").agg(F.count("*").alias("p"))
    # k seeds in one text are k (k - 1) / 2 pairs, and count k - 1 times too often
    again = met.groupBy("query").agg(F.sum(F.round((F.sqrt(F.col("p") * 8 + 1) - 1) / 2).cast("long")).alias("again"))
    return every.join(again, "query", "left").select("query", (F.col("n") - F.coalesce("again", F.lit(0))).alias("facts"))
