"""The service's calls as functions over a session and stored tables; no web server."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import words
from graphloom.operators import rank, vector_index
from graphloom.operators.graph import HUB, hubs
from graphloom.plans import embeddings, lanes
from graphloom.protocols import Embedder, default_embedder
from graphloom.settings import DEFAULTS, Settings
from graphloom.sources import readers
from graphloom.streaming import merge


class BadRequest(ValueError):
    """A request that can't be answered, with its status."""

    status = 400


class Service:
    """Answers questions over a stored graph, the index of its entity vectors, the postings of their names, and a chunk table with its index, all under `root`.

    Tables are opened on first use, or by preload, and dropped by close; it is a context manager. What
    isn't stored is made on first use: store_vectors, store_chunks and store_postings save that.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS, embed: Embedder = default_embedder, count_tokens: Callable[[str], int] = lambda text: len(text.split())):
        self.spark, self.root, self.settings, self.embed, self.count_tokens = spark, root, settings, embed, count_tokens
        self._open: dict[str, DataFrame] = {}
        self._indexes: dict[str, vector_index.Index] = {}

    def __enter__(self) -> Service:
        return self.preload()

    def __exit__(self, *_) -> None:
        self.close()

    def preload(self) -> Service:
        """Opens all tables that are there, and keeps the entity vectors in the executors' storage."""
        self.graph()
        index = self.index()
        self._open["vectors"] = index.rows.persist()
        self._open["vectors"].count()
        self._indexes["vectors"] = index._replace(rows=self._open["vectors"])
        return self

    def close(self) -> None:
        for table in self._open.values():
            table.unpersist()
        self._open, self._indexes = {}, {}

    def graph(self) -> tuple[DataFrame, DataFrame]:
        if "nodes" not in self._open:
            found = merge.read_graph(self.spark, self.root)
            if found is None:
                raise BadRequest("there is no graph")
            self._open["nodes"], self._open["edges"] = found
        return self._open["nodes"], self._open["edges"]

    def vectors(self) -> DataFrame:
        """name, embedding of the entities: as stored, or else computed."""
        return self.index().rows.select("name", "embedding")

    def _index(self, name: str, made: Callable[[], DataFrame]) -> vector_index.Index:
        if name not in self._indexes:
            path = f"{self.root}/{name}"
            there = readers.exists(self.spark, f"{path}_centres/_SUCCESS")
            self._indexes[name] = vector_index.read_index(self.spark, path) if there else vector_index.build(made())
        return self._indexes[name]

    def index(self) -> vector_index.Index:
        """That of the entities' vectors."""
        return self._index("vectors", lambda: lanes.entity_vectors(self.graph()[0], self.embed))

    def stores(self) -> lanes.Stores:
        held = (f"{self.root}/{x}" for x in ("postings", "hubs"))
        return lanes.Stores(self.index(), *(self.spark.read.parquet(x) if readers.exists(self.spark, f"{x}/_SUCCESS") else None for x in held))

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/chunks")

    def chunk_index(self) -> vector_index.Index:
        """That of the chunks' vectors, by chunk_id: each distinct text is embedded once, and those of the embedding store not at all."""
        return self._index("chunk_vectors", lambda: embeddings.embedded(self.chunks().select(F.col("chunk_id").alias("name"), "text"), f"{self.root}/embeddings", self.embed))

    def store_vectors(self) -> None:
        """Writes each distinct entity name's embedding, once, with its list of the index."""
        vector_index.write_vectors(lanes.entity_vectors(self.graph()[0], self.embed), f"{self.root}/vectors")
        self._indexes.pop("vectors", None)

    def store_chunks(self) -> None:
        """Writes the index of the chunks' vectors; only texts that the embedding store lacks are embedded, and it forgets those that no chunk has."""
        rows = embeddings.embedded(self.chunks().select(F.col("chunk_id").alias("name"), "text"), f"{self.root}/embeddings", self.embed)
        vector_index.write_vectors(rows.select("name", "embedding"), f"{self.root}/chunk_vectors")
        self._indexes.pop("chunk_vectors", None)

    def store_postings(self) -> None:
        """Writes the entity names under their runs of characters."""
        rank.postings(self.graph()[0]).repartition("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.root}/postings")

    def store_hubs(self, most: int = HUB) -> None:
        """Writes which nodes' edges are to be dealt over several tasks."""
        hubs(self.graph()[1], most).write.mode("overwrite").parquet(f"{self.root}/hubs")

    def _asked(self, question: str) -> DataFrame:
        if not question or not question.strip():
            raise BadRequest("the question is empty")
        return self.spark.createDataFrame([(0, question)], "query long, question string")

    def ask(self, question: str, hops: int | None = None) -> dict:
        """answer, citations, sources, latency by stage in milliseconds, and tokens; a stage's few rows of one question come to the driver."""
        s, clock = self.settings, {}

        def stage(name: str, rows: DataFrame) -> DataFrame:
            began = time.perf_counter()
            held = rows.collect()
            clock[f"{name}_ms"] = round(1000 * (time.perf_counter() - began))
            return self.spark.createDataFrame(held, rows.schema)

        asked, began = self._asked(question), time.perf_counter()
        nodes, edges = self.graph()
        embedded = stage("embed", lanes.with_embedding(asked, "question", self.embed))
        found = stage("seeds", lanes.seeds(nodes, embedded, s=s, stores=self.stores()))
        facts = stage("facts", lanes.graph_facts(edges, nodes, found, asked, hops=s.hops if hops is None else hops, s=s, stores=self.stores()))
        row = stage("answer", lanes.answered(facts, asked, s=s)).first().asDict(recursive=True)
        clock["total_ms"] = round(1000 * (time.perf_counter() - began))
        return {k: row[k] for k in ("answer", "citations", "sources")} | {"latency": clock, "tokens": {"context": self.count_tokens(row["context"]), "answer": self.count_tokens(row["answer"])}}

    def ask_both(self, question: str, hops: int | None = None) -> dict:
        asked, s = self._asked(question), self.settings
        nodes, edges = self.graph()
        a = lanes.graph_lane(edges, nodes, asked, self.embed, hops=s.hops if hops is None else hops, s=s, stores=self.stores())
        return lanes.both_lanes(a, lanes.chunk_lane(self.chunks(), asked, self.embed, s=s, index=self.chunk_index())).first().asDict(recursive=True)

    def ask_many(self, questions: DataFrame, path: str, hops: int | None = None) -> dict:
        """Writes the graph lane's rows for a batch (query, question) to path; how many questions, how many without facts, and the tokens of contexts and answers.

        The figures are observed by the job that writes: no row comes to the driver and nothing runs twice.
        Tokens are white-space words.
        """
        s, (nodes, edges), seen = self.settings, self.graph(), Observation("answers")
        told = lanes.graph_lane(edges, nodes, questions, self.embed, hops=s.hops if hops is None else hops, s=s, stores=self.stores())
        tokens = lambda c: F.coalesce(F.sum(F.size(words(F.col(c)))), F.lit(0)).cast("long")
        told.observe(seen, F.count(F.lit(1)).alias("questions"), F.count_if(F.col("context") == "").alias("without_facts"), tokens("context").alias("context_tokens"), tokens("answer").alias("answer_tokens")).write.mode("overwrite").parquet(path)
        return dict(seen.get)

    def delete_graph(self) -> dict:
        self.close()
        return {"deleted": merge.clear_graph(self.spark, self.root)}

    def health(self) -> dict:
        return {"status": "ok"}
