"""Communities of the graph, their summaries, and answers by community.

Detection is Leiden's: nodes move between communities by modularity; a community is refined into parts,
which grow from single nodes by moves inside it alone and are connected; and the parts are the nodes of
the next, coarser graph, where they begin in the community that they came from. Clusters over the
largest size are split again on their inner edges, so that a node is listed with its coarse and its
fine clusters; what moves don't split stays whole. In a round, half of the nodes, by a bit of their names' checksum, move at
once, each to the community with the greatest gain; gains are integers, so that a round's result
doesn't depend on any order. Groups of up to LARGE links are computed in one task each, larger ones
by joins over all their links: the same rounds, with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import written
from graphloom.functions.text import is_non_answer, strip_role
from graphloom.functions.vectors import cosine
from graphloom.operators.components import components
from graphloom.settings import DEFAULTS

#: Links of a group that one task computes; and rounds of moves at most, in pairs in which each node may move once; one without a move ends a level.
LARGE, ROUNDS = 200_000, 12


def simple_graph(edges: DataFrame) -> DataFrame:
    """a < b, relationship, description: one undirected edge per pair, the last by seq; no self-loops are lost."""
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relationship", "description", "seq")
    return pair.groupBy("a", "b").agg(F.max_by(F.struct("relationship", "description"), F.struct("seq", "relationship", "description")).alias("e")).select("a", "b", "e.*")


def graph_of(triplets: DataFrame) -> DataFrame:
    """The simple graph of a stored graph's triplets, by names; the description of an edge is its section."""
    return simple_graph(triplets.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "relationship", F.coalesce("section", F.lit("")).alias("description"), F.struct("src", "dst").alias("seq")))


def _is_active(checksum, turn: int):
    """Whether a node moves in this round: each does in one of two rounds."""
    return ((checksum >> (turn // 2 % 16)) + turn) % 2 == 0


def _moved(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: np.ndarray, checksum: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Communities, as nodes' numbers, after the rounds of one level over links (x, y) in both directions with weights w, from label on; k: the nodes' strengths."""
    n, total, quiet = len(k), int(k.sum()), 0
    for turn in range(ROUNDS):
        key, place = np.unique(np.concatenate([x * n + label[y], np.arange(n) * n + label]), return_inverse=True)
        near = np.zeros(len(key), np.int64)
        np.add.at(near, place[: len(w)], w)
        node, to = key // n, key % n
        strength, size = np.zeros(n, np.int64), np.bincount(label, minlength=n)
        np.add.at(strength, label, k)
        own = to == label[node]
        gain = near * total - k[node] * (strength[to] - np.where(own, k[node], 0))
        order = np.lexsort((to, ~own, -gain, node))
        best = order[np.searchsorted(node[order], np.arange(n))]
        here = np.flatnonzero(own)  # one a node, in order
        move = _is_active(checksum, turn) & (gain[best] > gain[here]) & ~((size[label] == 1) & (size[to[best]] == 1) & (to[best] > label))
        label = np.where(move, to[best], label)
        quiet = 0 if move.any() else quiet + 1
        if turn % 2 and quiet > 1:
            break
    return label


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes the least that links (a, b) connect each with."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _refined(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: np.ndarray, checksum: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Connected parts of the communities of label, by their least node: nodes begin alone, and move along links inside their community."""
    inside = label[x] == label[y]
    x, y, w = x[inside], y[inside], w[inside]
    part = _moved(x, y, w, k, checksum, np.arange(len(k)))
    same = part[x] == part[y]
    return _joined(len(k), x[same], y[same])


def local_moving(names: list[str], pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Connected clusters of an unweighted graph of sorted names and distinct pairs (a < b), in order of their least names."""
    number = {n: i for i, n in enumerate(names)}
    a, b = (np.array([number[p[i]] for p in pairs], np.int64) for i in (0, 1))
    x, y = np.concatenate([a, b]), np.concatenate([b, a])
    at, low, high, w, k, of = np.arange(len(names)), x, y, np.ones(len(x), np.int64), np.bincount(x, minlength=len(names)), np.arange(len(names))
    label = start = at
    while len(w):
        checksum = np.array([zlib.crc32(names[i].encode()) for i in of])
        moved = _moved(low, high, w, k, checksum, start)
        label = moved[at]
        kept, part = np.unique(_refined(low, high, w, k, checksum, moved), return_inverse=True)
        if len(kept) == len(of):
            break
        _, first, community = np.unique(moved[kept], return_index=True, return_inverse=True)
        start, at, of = first[community], part[at], of[kept]
        key, place = np.unique(part[low] * len(of) + part[high], return_inverse=True)
        weight, strength = np.zeros(len(key), np.int64), np.zeros(len(of), np.int64)
        np.add.at(weight, place, w)
        np.add.at(strength, part, k)
        low, high, w, k = key // len(of), key % len(of), weight, strength
        inner = low == high
        low, high, w = low[~inner], high[~inner], w[~inner]
    # parts of communities that links hold together
    inside = label[a] == label[b]
    root = _joined(len(names), a[inside], b[inside])
    groups: dict[int, list[str]] = {}
    for n, r in zip(names, root.tolist()):
        groups.setdefault(r, []).append(n)
    return list(groups.values())


def hierarchy(names: list[str], pairs: list[tuple[str, str]], most: int, level: int = 0) -> list[tuple[str, int, str]]:
    """(node, level, cluster) of the clusters of a group, named by least node and level; those over `most` nodes are split again.

    level: that of the group's clusters. Over 0 the group is itself a cluster that is too large, and
    has no finer ones where moves don't split it.
    """
    out, todo = [], [(names, pairs, level)]
    while todo:
        names, pairs, level = todo.pop()
        parts = local_moving(names, pairs)
        if len(parts) == 1 and level:
            continue
        of = {n: i for i, part in enumerate(parts) for n in part}
        inner: list[list[tuple[str, str]]] = [[] for _ in parts]
        for a, b in pairs:
            if of[a] == of[b]:
                inner[of[a]].append((a, b))
        for part, links in zip(parts, inner):
            name = f"{min(part)}/{level}"  # once a part: for each node it would be quadratic
            out += [(n, level, name) for n in part]
            if len(part) > most:
                todo.append((part, links, level + 1))
    return out


#: Sums of links up to here have products that a long holds.
EXACT = 3_000_000_000


def _by(rows: DataFrame) -> DataFrame:
    """Rows a node, which are shuffled and never sent whole: their files are far smaller than they are in the driver's memory."""
    return rows.hint("merge")


def _moved_by_joins(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (g, node, k, label, crc, total) with their labels after the rounds of one level: _moved over links (x, y, w) of many groups.

    Nodes are numbers in order of their names, of which crc is the checksum; total: the sum of a group's k.
    """
    # a long's product is several times as fast as a decimal's
    wide = "decimal(38,0)" if (nodes.agg(F.max("total")).first()[0] or 0) >= EXACT else "long"
    one, two = ("decimal(19,0)", "decimal(18,0)") if wide != "long" else ("long", "long")
    labels, quiet = nodes, 0
    for turn in range(ROUNDS):
        sizes = labels.groupBy("label").agg(F.sum("k").alias("strength"), F.count("*").alias("size"))
        near = links.join(_by(labels.select(F.col("node").alias("y"), "label")), "y").select(F.col("x").alias("node"), F.col("label").alias("to"), "w")
        near = near.unionByName(labels.select("node", F.col("label").alias("to"), F.lit(0).cast("long").alias("w"))).groupBy("node", "to").agg(F.sum("w").alias("w"))
        seen = near.join(_by(sizes.withColumnRenamed("label", "to")), "to").join(_by(labels), "node")
        own = F.col("to") == F.col("label")
        gain = F.col("w").cast(one) * F.col("total").cast(two) - F.col("k").cast(one) * (F.col("strength") - F.when(own, F.col("k")).otherwise(0)).cast(two)
        seen = seen.withColumn("own", own).withColumn("gain", gain.cast(wide))
        best = seen.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), (~F.col("own")).alias("other"), "to", "size")).alias("best"), F.max(F.when(F.col("own"), F.struct("gain", "size"))).alias("here"), *(F.max(x).alias(x) for x in ("g", "k", "label", "crc", "total")))
        lone = (F.col("here.size") == 1) & (F.col("best.size") == 1) & (F.col("best.to") > F.col("label"))
        active = F.expr(f"(shiftright(crc, {turn // 2 % 16}) + {turn}) % 2 = 0")
        move = active & (-F.col("best.loss") > F.col("here.gain")) & ~lone
        new = written(best.select("g", "node", "k", F.when(move, F.col("best.to")).otherwise(F.col("label")).alias("label"), "crc", "total", move.alias("move")))
        quiet = quiet + 1 if new.filter("move").isEmpty() else 0
        labels = new.drop("move")
        if turn % 2 and quiet > 1:
            break
    return labels


def _split_by_joins(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, node, part (its least node) of groups' nodes (g, node, crc), as local_moving splits each by its links (g, x, y)."""
    both = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).withColumn("w", F.lit(1).cast("long")))
    strength = both.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k"))
    now = nodes.select("g", "node", "crc", F.col("node").alias("label")).join(_by(strength), "node", "left").fillna(0, ["k"])
    now = written(now.join(now.groupBy("g").agg(F.sum("k").alias("total")), "g"))
    edges, of, done = both, now.select("node", F.col("node").alias("at")), None

    def within(rows: DataFrame, by: DataFrame) -> DataFrame:
        """The links whose ends have one label."""
        x, y = (_by(by.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))) for c in ("x", "y"))
        return rows.join(x, "x").join(y, "y").filter("lx = ly").select("x", "y", "w")

    while True:
        moved = _moved_by_joins(edges, now)
        placed = of.join(_by(moved.select("g", F.col("node").alias("at"), "label")), "at")
        inner = written(within(edges, moved))
        refined = _moved_by_joins(inner, moved.withColumn("label", F.col("node")))
        roots = components(within(inner, refined).select(F.col("x").alias("a"), F.col("y").alias("b")), written, _by)
        parts = written(moved.join(_by(roots), "node", "left").select("g", "node", "k", "label", "crc", "total", F.coalesce("root", "node").alias("part")))
        going = written(parts.filter("part <> node").select("g").distinct())
        ended = written(placed.join(going, "g", "left_anti").select("node", "label"))
        done = ended if done is None else done.unionByName(ended)
        if going.isEmpty():
            break
        parts = parts.join(going, "g", "left_semi")
        fewer = parts.groupBy("g", F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.min("label").alias("was"), F.max(F.when(F.col("node") == F.col("part"), F.col("crc"))).alias("crc"), F.max("total").alias("total"))
        start = fewer.groupBy("was").agg(F.min("node").alias("label"))
        now = written(fewer.join(_by(start), "was").select("g", "node", "k", "label", "crc", "total"))
        of = written(of.join(_by(parts.select(F.col("node").alias("at"), "part")), "at").select("node", F.col("part").alias("at")))
        to = parts.select(F.col("node").alias("x"), F.col("part").alias("u"))
        edges = edges.join(_by(to), "x").join(_by(to.select(F.col("x").alias("y"), F.col("u").alias("v"))), "y").filter("u <> v")
        edges = written(edges.groupBy(F.col("u").alias("x"), F.col("v").alias("y")).agg(F.sum("w").alias("w")))
    x, y = (_by(done.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))) for c in ("x", "y"))
    inside = links.join(x, "x").join(y, "y").filter("lx = ly").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return written(nodes.select("g", "node").join(_by(components(inside, written, _by)), "node", "left").select("g", "node", F.coalesce("root", "node").alias("part")))


def _numbered(nodes: DataFrame) -> DataFrame:
    """name, node, crc of names (name): their numbers in order, and their checksums."""
    found = nodes.repartitionByRange("name").sortWithinPartitions("name")
    return written(found.select("name", F.monotonically_increasing_id().alias("node"), F.crc32("name").alias("crc")))


def communities(graph: DataFrame, most: int = DEFAULTS.max_cluster_size) -> DataFrame:
    """node, level, cluster (`least node/level`) of a simple graph (a, b). In joins, nodes are numbers in order of their names."""
    every = written(graph.select("a", "b").distinct())
    numbers = _numbered(every.select(F.explode(F.array("a", "b")).alias("name")).distinct())
    number = lambda end, out: _by(numbers.select(F.col("name").alias(end), F.col("node").alias(out)))
    links = written(every.filter("a <> b").join(number("a", "x"), "a").join(number("b", "y"), "b").select("x", "y"))
    groups = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), written, _by)
    nodes = written(numbers.join(_by(groups), "node", "left").select(F.coalesce("root", "node").alias("g"), "node", "crc"))
    links = written(links.join(_by(nodes.select("g", F.col("node").alias("x"))), "x").select("g", "x", "y"))
    out, level = None, 0
    name = lambda x, out: _by(numbers.select(F.col("node").alias(x), F.col("name").alias(out)))

    def whole(at: int):
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            alone = rows["b"].isna()
            pairs = list(zip(rows["a"][~alone], rows["b"][~alone]))
            return pd.DataFrame(hierarchy(sorted(rows["a"][alone]), pairs, most, at), columns=["node", "level", "cluster"])

        return one

    while True:
        large = written(links.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("g"))
        rows = links.join(large, "g", "left_anti").join(name("x", "a"), "x").join(name("y", "b"), "y").select("g", "a", "b")
        rows = rows.unionByName(nodes.join(large, "g", "left_anti").join(name("node", "a"), "node").select("g", "a", F.lit(None).cast("string").alias("b")))
        found = rows.groupBy("g").applyInPandas(whole(level), "node string, level int, cluster string")
        out = found if out is None else out.unionByName(found)
        if large.isEmpty():
            return out
        nodes, links = nodes.join(large, "g", "left_semi"), links.join(large, "g", "left_semi")
        parts = _split_by_joins(links, nodes)
        if level:  # what isn't split has no finer clusters
            split = parts.groupBy("g").agg(F.count_distinct("part").alias("n")).filter("n > 1").select("g")
            parts = written(parts.join(split, "g", "left_semi"))
        named = parts.join(name("node", "name"), "node").join(name("part", "least"), "part")
        out = out.unionByName(named.select(F.col("name").alias("node"), F.lit(level).alias("level"), F.concat("least", F.lit(f"/{level}")).alias("cluster")))
        over = parts.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("part")
        nodes = written(parts.join(_by(over), "part", "left_semi").select(F.col("part").alias("g"), "node").join(_by(numbers.select("node", "crc")), "node"))
        side = lambda x, name: _by(nodes.select(F.col("g").alias(name), F.col("node").alias(x)))
        links = written(links.drop("g").join(side("x", "g"), "x").join(side("y", "h"), "y").filter("g = h").select("g", "x", "y"))
        level += 1


def entity_communities(members: DataFrame) -> DataFrame:
    """node, clusters: those of all levels."""
    return members.groupBy("node").agg(F.sort_array(F.collect_set("cluster")).alias("clusters"))


def community_details(members: DataFrame, graph: DataFrame) -> DataFrame:
    """cluster, node, neighbour, detail: each member's every edge, those that leave the cluster too."""
    both = graph.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "relationship", "description").unionByName(graph.filter("a <> b").select(F.col("b").alias("node"), F.col("a").alias("neighbour"), "relationship", "description"))
    detail = F.concat_ws(" -> ", "node", "neighbour", F.coalesce("relationship", F.lit("")), F.coalesce("description", F.lit("")))
    return members.select("cluster", "node").distinct().join(both, "node").select("cluster", "node", "neighbour", detail.alias("detail"))


def texts(details: DataFrame) -> DataFrame:
    """cluster, text: the details' lines and a full stop."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "neighbour", "detail"))), lambda x: x["detail"]), "\n")
    return details.groupBy("cluster").agg(F.concat(lines, F.lit(".")).alias("text"))


def summarised(rows: DataFrame, summarise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """rows with a summary in place of their text; the default summariser is the text itself."""
    return rows.withColumn("summary", strip_role(summarise(F.col("text")))).drop("text")


def summaries(details: DataFrame, summarise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """cluster, summary."""
    return summarised(texts(details), summarise)


# fixed value: name -> relation -> name, one a line
PATH = r"(?im)^([\p{L}\p{N}_\-'&.]+(?:\s+[\p{L}\p{N}_\-'&.]+)*)\s*->\s*([a-z\s]+?)\s*->\s*([\p{L}\p{N}_\-'&.]+(?:\s+[\p{L}\p{N}_\-'&.]+)*)$"


def path_entities(text: Column) -> Column:
    """The distinct names at either end of the paths in a text."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(PATH), F.lit(1)), F.regexp_extract_all(text, F.lit(PATH), F.lit(3))))


def candidate_communities(entities: DataFrame, members: DataFrame) -> DataFrame:
    """query, cluster: the communities, of all levels, of a question's entities (query, name)."""
    return entities.join(members.select(F.col("node").alias("name"), "cluster"), "name").select("query", "cluster").distinct()


def rank_communities(candidates: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = DEFAULTS.top_k_communities) -> DataFrame:
    """query, cluster, score, rank: k candidates or fewer pass unscored, by name; of more the k nearest.

    vectors: cluster, embedding; questions: query, embedding.
    """
    found = candidates.join(vectors, "cluster").join(questions.select("query", F.col("embedding").alias("q")), "query")
    found = found.withColumn("_n", F.count("*").over(Window.partitionBy("query")))
    score = F.when(F.col("_n") > k, F.round(cosine(F.col("embedding"), F.col("q"), 1e-8), 6))
    found = found.select("query", "cluster", score.alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "cluster"))).filter(F.col("rank") <= k)


NOTHING_FOUND = "No relevant information found in the knowledge graph."


def reduce_answers(questions: DataFrame, partial: DataFrame, combine: Callable[[Column], Column] = lambda answers: F.array_join(answers, " ")) -> DataFrame:
    """query, answer from partial answers (query, rank, answer); null answers are failures and left out.

    Without a concrete answer it is the first partial one, or the standard text if there is none;
    a single concrete answer is the answer; more are combined, the first standing in for a null.
    """
    got = partial.filter("answer is not null").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "answer"))).alias("p"))
    every = questions.select("query").join(got, "query", "left")
    answers = F.transform(F.coalesce("p", F.array().cast("array<struct<rank:int,answer:string>>")), lambda x: strip_role(x["answer"]))
    found = every.select("query", answers.alias("all"), F.filter(answers, lambda a: ~is_non_answer(a)).alias("good"))
    answer = F.when(F.size("good") == 0, F.coalesce(F.get("all", F.lit(0)), F.lit(NOTHING_FOUND))).when(F.size("good") == 1, F.get("good", F.lit(0))).otherwise(F.coalesce(strip_role(combine(F.col("good"))), F.get("good", F.lit(0))))
    return found.select("query", answer.alias("answer"))
