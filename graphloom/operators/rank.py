"""Seed search, rank fusion, re-ranking and citations, each for a whole batch of questions.

Every ordering has a total tie-break. Questions are a stated set against all rows, found by an index of
the names' runs of characters or of the vectors, and no side has a broadcast hint: the optimizer goes by
size. Top-k windows keep k rows a question in each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.checkpoints import cut
from graphloom.functions.text import join_facts, query_words, words
from graphloom.functions.vectors import overlap
from graphloom.operators import vector_index
from graphloom.operators.graph import SENT
from graphloom.settings import DEFAULTS


def _top(rows: DataFrame, per: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("rank") <= k)


#: Length of the character runs that names are found by.
GRAM = 5


def _runs(text: Column, n: int) -> Column:
    """The text's runs of n characters; none if it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def postings(names: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """gram, name, low: each distinct name (name) under each run of up to GRAM characters of it in lower case, and under the empty one.

    lengths: those of the runs that will be asked for, in place of all.
    """
    low = names.filter("name is not null").select("name", F.lower("name").alias("low")).distinct()
    runs = [F.array(F.lit("")) if n == 0 else _runs(F.col("low"), n) for n in (range(GRAM + 1) if lengths is None else lengths)]
    return low.select(F.explode(F.array_distinct(F.concat(*runs))).alias("gram"), "name", "low")


def _postings_of(words_: DataFrame, names: DataFrame) -> DataFrame:
    """postings of names under runs of the lengths that words_ (word) are looked up by."""
    lengths = [r["n"] for r in words_.select(F.least(F.length("word"), F.lit(GRAM)).alias("n")).distinct().sort("n").collect()]  # GRAM + 1 rows at most
    return postings(names, lengths or [0])


def holding(words_: DataFrame, index: DataFrame) -> DataFrame:
    """name, word: which names of the postings hold which of the distinct words (word). A word is looked up under the rarest of its runs of characters."""
    word = F.col("word")
    of = words_.select("word", F.explode(F.array_distinct(F.when(F.length(word) < GRAM, F.array(word)).otherwise(_runs(word, GRAM)))).alias("gram"))
    held = index.join(of.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of.join(often, "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return held.join(rarest, "gram").filter(F.contains("low", "word")).select("name", "word")


def keyword_seeds(names: DataFrame, questions: DataFrame, limit: int = DEFAULTS.seed_limit, index: DataFrame | None = None) -> DataFrame:
    """query, name, hits, rank: names (name) that hold most of the question's words (query, question).

    A word that the question repeats counts as often; punctuation belongs to words, and a word may lie
    anywhere in a name. A word is looked up under the rarest of its runs of characters, and what
    is found there is verified. Names that hold the same words differ for no question: the first of them
    alone meet the questions. Equal questions are asked once. index: stored postings of the names, in place of those made here.
    """
    given = questions.select("query", "question").filter("question is not null")
    one = cut(given.groupBy("question").agg(F.min("query").alias("query")))
    asked = cut(one.select("query", F.explode(query_words(F.col("question"))).alias("word")).groupBy("query", "word").agg(F.count("*").alias("times")))
    words_ = asked.select("word").distinct()
    hit = holding(words_, _postings_of(words_, names) if index is None else index)
    alike = hit.groupBy("name").agg(F.sort_array(F.collect_set("word")).alias("words"))
    first = _top(alike, "words", limit, F.asc("name")).select("name", F.explode("words").alias("word"))
    found = first.join(asked, "word").groupBy("query", "name").agg(F.sum("times").alias("hits"))
    top = _top(found, "query", limit, F.desc("hits"), F.asc("name")).withColumnRenamed("query", "_one")
    return given.join(one.withColumnRenamed("query", "_one"), "question").select("query", "_one").join(top, "_one").select("query", "name", "hits", "rank")


def _first_alike(items: DataFrame, k: int) -> DataFrame:
    """The first k by name of the items with one vector, which are as near to every question; a hash leads the sort.

    Cut, so that no later filter on the vectors makes them again, or before names are distinct.
    """
    first = Window.partitionBy("_hash", "embedding").orderBy("name")
    found = items.select("name", "embedding").withColumn("_hash", F.xxhash64("embedding")).withColumn("_n", F.row_number().over(first))
    return cut(found.filter(F.col("_n") <= k).select("name", "embedding"))


def vector_seeds(items: DataFrame, questions: DataFrame, limit: int = DEFAULTS.seed_limit, min_score: float = DEFAULTS.seed_min_score, scale: str = "normalized", index: vector_index.Index | None = None) -> DataFrame:
    """query, name, score, rank of the nearest items (name, embedding) to questions (query, embedding), of all items.

    The limit comes first and the least score after it. scale: `cosine`, or `normalized`, which is
    (1 + cosine) / 2. index: a stored index of the items, in place of one made here.
    """
    held = vector_index.build(_first_alike(items, limit), bare=True) if index is None else index
    return vector_index.nearest(held, questions, limit, scale).filter(F.col("score") >= min_score).select("query", "name", "score", "rank")


def fuse(lists: list[DataFrame], k: int = DEFAULTS.rrf_k, limit: int | None = None) -> DataFrame:
    """query, name, score, rank by reciprocal rank fusion of lists (query, name, rank); ties: first seen in list order."""
    every = None
    for i, x in enumerate(lists):
        x = x.select("query", "name", F.lit(i).alias("list"), "rank")
        every = x if every is None else every.unionByName(x)
    # added up in the order of the lists, so that the sum's last digit is the same each time
    parts = F.sort_array(F.collect_list(F.struct("list", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("x"))))
    score = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["x"])
    merged = every.groupBy("query", "name").agg(score.alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "seen", "name"))).drop("seen")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _with_hits(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """facts with hits, the number of distinct words of the question in the fact."""
    asked = questions.select("query", F.array_distinct(words(F.lower("question"))).alias("words"))
    hits = F.size(F.filter("words", lambda w: F.contains(F.lower("fact_text"), w))).cast("long")
    return facts.join(asked, "query").withColumn("hits", hits).drop("words")


def first_facts(facts: DataFrame, questions: DataFrame, k: int, ranks: int) -> DataFrame:
    """Of rows of facts (query, rank, ..., fact_text), not yet once a fact, those that can be of the first k by preranked.

    A fact may come with each of `ranks` ranks, so that k facts have at most k times as many different
    rows; equal ones share a place. Each task drops the rest before the shuffle.
    """
    place = F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("hits"), "rank", "subject", "relationship", "object"))
    return _with_hits(facts, questions).withColumn("_d", place).filter(F.col("_d") <= k * ranks).drop("_d", "hits")


#: Words that most questions have, whose places in a fact are bits of a number.
COMMON = 16


def with_held(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """edges with what their facts hold of all questions' words: _mask, a bit for each of the most common words, and _rare, the other ones.

    A word has no white space, so that a fact holds it if one of its names does: words are looked for once a
    distinct name, by its runs of characters, and not once an edge or a question.
    """
    asked = cut(questions.select("query", F.explode(F.array_distinct(words(F.lower("question")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    common = [r["word"] for r in asked.filter("n > 1").sort(F.desc("n"), "word").limit(COMMON).collect()]
    relationship = F.replace(F.col("relationship"), F.lit("_"), F.lit(" "))
    names = edges.select(F.explode(F.array("subject", "object", relationship)).alias("name")).distinct()
    words_ = asked.select("word")
    hit = holding(words_, _postings_of(words_, names))
    bit, rare = F.lit(0).cast("long"), F.when(~F.col("word").isin(*common), F.col("word")) if common else F.col("word")
    for i, w in enumerate(common):
        bit = F.when(F.col("word") == w, F.lit(1 << i).cast("long")).otherwise(bit)
    told = cut(hit.groupBy("name").agg(F.bit_or(bit).alias("mask"), F.collect_set(rare).alias("rare")))
    found = edges.withColumn("_relationship", relationship)
    by = cut(told.join(edges.select(relationship.alias("name")).distinct(), "name", "left_semi"))
    sent = F.broadcast if by.count() <= SENT else lambda rows: rows
    for name in ("subject", "object", "_relationship"):
        of = told if name != "_relationship" else sent(by)
        found = found.join(of.select(F.col("name").alias(name), F.col("mask").alias(f"_m{name}"), F.col("rare").alias(f"_r{name}")), name, "left")
    masks, rares = ([F.coalesce(f"_{x}{name}", empty) for name in ("subject", "object", "_relationship")] for x, empty in (("m", F.lit(0).cast("long")), ("r", F.array().cast("array<string>"))))
    mask = masks[0].bitwiseOR(masks[1]).bitwiseOR(masks[2])
    return found.select(*edges.columns, mask.alias("_mask"), F.array_sort(F.array_distinct(F.concat(*rares))).alias("_rare"))


def first_of_starts(k: int, questions: DataFrame | None = None) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """What leaves, of the edges (with_held) that a start reaches, those that can be of the first k by preranked of some question.

    A question has all that a start reaches with that start's rank or a better one. Edges of one node that
    hold the same common words have as many of these; where such an edge holds no rare word of the question,
    k of them before it, by names, keep it from its first k. One that does is held against those with the
    same rare words, and meets only starts of questions with one of these, if questions are given. So a
    node's edges are left out before its starts meet them. A fact that comes with a worse rank than its
    own, whose row was left out, isn't among the first either.
    """

    def first(rows: DataFrame, *by: str) -> DataFrame:
        place = F.dense_rank().over(Window.partitionBy(*by).orderBy("subject", "relationship", "object"))
        return rows.withColumn("_d", place).filter(F.col("_d") <= k).drop("_d")

    def of_start(edges: DataFrame, near: DataFrame, seeds: DataFrame) -> DataFrame:
        ends = edges.withColumn("node", F.explode(F.array_distinct(F.array("src", "dst"))))
        told = first(ends.filter("size(_rare) > 0"), "node", "_mask", "_rare")
        if questions is None:
            some = near.join(told, "node")
        else:
            asked = questions.select("query", F.explode(words(F.lower("question"))).alias("word"))
            of = seeds.select("query", F.col("node").alias("start")).join(asked, "query").select("start", "word").distinct()
            some = told.withColumn("word", F.explode("_rare")).join(of, "word").drop("word").join(near, ["start", "node"])
        every = near.join(first(ends, "node", "_mask"), "node")
        kept = [first(every, "start", "_mask"), first(some.select(every.columns), "start", "_mask", "_rare")]
        return kept[0].unionByName(kept[1]).drop("node", "_mask", "_rare")

    return of_start


def preranked(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """facts with hits and place: by distinct words of the question in the fact, then by seed and names."""
    found = _with_hits(facts, questions)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hits"), "rank", "subject", "relationship", "object")))


Scorer = Callable[[Column, Column], Column]


def gated_rerank(ranked: DataFrame, questions: DataFrame, scorer: Scorer | None = overlap, max_facts: int | None = DEFAULTS.max_context_facts, above: int = DEFAULTS.rerank_above, pool: int = DEFAULTS.rerank_pool) -> DataFrame:
    """Facts in their final place.

    A question with more than `above` facts has its first `pool` scored and ordered anew; others
    keep their order. scorer: (question, text) -> column, a pandas UDF say; None keeps the order.
    The first places alone are gathered, which each task keeps before the shuffle.
    """
    first = ranked.filter(F.col("place") <= max(pool, above + 1))
    every = first.withColumn("_n", F.count("*").over(Window.partitionBy("query"))).filter((F.col("_n") <= above) | (F.col("place") <= pool))
    found = every.join(questions.select("query", "question"), "query")
    score = F.lit(None).cast("double") if scorer is None else F.when(F.col("_n") > above, F.round(scorer(F.col("question"), F.col("fact_text")), 6))
    found = found.withColumn("score", score).drop("question", "_n")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "place"))
    found = found.withColumn("place", place)
    return found if max_facts is None else found.filter(F.col("place") <= max_facts)


def citations(facts: DataFrame, limit: int | None = None) -> DataFrame:
    """query, cite, fact_text, page_number, source, bbox, section: the best placed fact of each (page, section, bbox).

    The source is no part of that key. Facts with neither page (0 is none) nor source are left out.
    """
    known = facts.filter((F.coalesce("page_number", F.lit(0)) != 0) | (F.coalesce("source", F.lit("")) != "")).withColumn("section", F.coalesce("section", F.lit("")))
    key = ("query", "page_number", "section", "bbox")
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("place"))).filter("_n = 1")
    out = first.withColumn("cite", F.row_number().over(Window.partitionBy("query").orderBy("place"))).select("query", "cite", "fact_text", "page_number", "source", "bbox", "section")
    return out if limit is None else out.filter(F.col("cite") <= limit)


def sources(facts: DataFrame) -> DataFrame:
    return facts.filter("source <> ''").groupBy("query").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def context(facts: DataFrame) -> DataFrame:
    """query, context: the facts as a list, in their places."""
    return facts.groupBy("query").agg(join_facts(F.transform(F.sort_array(F.collect_list(F.struct("place", "fact_text"))), lambda x: x["fact_text"])).alias("context"))


def retrieve_chunks(chunks: DataFrame, questions: DataFrame, scorer: Scorer | None = overlap, top_k: int = DEFAULTS.top_k_chunks, candidates: int = DEFAULTS.chunk_candidates, min_score: float = DEFAULTS.chunk_min_score, index: vector_index.Index | None = None) -> DataFrame:
    """query, place, chunk_id, text, source, page_number, score.

    chunks: chunk_id (a key), text, source, page_number, and embedding unless there is an index, whose
    names are the chunks' ids; questions: query, question, embedding. The nearest `candidates` by
    cosine, of these those of min_score; where more than one is left and there is a scorer, they
    are ordered by it and those above 0 stay; of these the first top_k.
    """
    held = vector_index.build(_first_alike(chunks.select(F.col("chunk_id").cast("string").alias("name"), "embedding"), candidates), bare=True) if index is None else index
    near = vector_index.nearest(held, questions, candidates).filter(F.col("score") >= min_score)
    rows = chunks.select(F.col("chunk_id").cast("string").alias("name"), "chunk_id", "text", "source", "page_number")
    near = near.join(rows, "name").join(questions.select("query", "question"), "query")
    if scorer is not None:
        near = near.withColumn("_n", F.count("*").over(Window.partitionBy("query"))).withColumn("_s", F.round(scorer(F.col("question"), F.col("text")), 6))
        near = near.filter((F.col("_n") == 1) | (F.col("_s") > 0)).withColumn("score", F.when(F.col("_n") > 1, F.col("_s")).otherwise(F.col("score"))).drop("_n", "_s")
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rank"))).filter(F.col("place") <= top_k)
    return placed.select("query", "place", "chunk_id", "text", "source", F.nullif("page_number", F.lit(0)).alias("page_number"), F.round("score", 3).alias("score"))
