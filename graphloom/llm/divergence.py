"""Source divergence audit: how far apart the sources of a language are in the terms that they use.

Terms are counted by (lang, source) in each task, and kept where enough documents of the language have
them. A kept term's frequency in a group is a whole number of billionths, smoothed. The kept terms of a
language are dealt to blocks by hash, so that a block's matrix, groups by terms in 64-bit integers, has
about CELLS cells whatever the size of either. A block gives the sums of absolute differences of all
pairs of its groups, by broadcasting, and each group's heap of its most overrepresented terms; the
partial pair matrices are summed and the heaps merged.

Defined cases: a null text, language or source counts as empty; a group without terms has every kept
term zero times; a language with no kept terms has distances of 0 and no term rows; a source that is
alone in its language gives no pairs; repeated documents count as often; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import cut, table, trimmed

#: Documents of a language that a kept term is in, at least; term rows of a group; what each count has added.
LEAST, TOP, SMOOTHING = 30, 50, 5
UNIT = 1_000_000_000
#: Cells of a block's matrix, and of what is broadcast at once.
CELLS, TEMPORARY = 1 << 16, 1 << 21
#: Entries that a task counts before it hands them on, and bytes of a text that are split at once.
ENTRIES, PIECE = 300_000, 1 << 22
_LETTER = bytes(32 if i <= 64 or 91 <= i <= 96 or 123 <= i <= 127 else i + 32 if i < 91 else i for i in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms, in pieces that end between terms."""
    text, at = text.translate(_LETTER), 0
    while len(text) - at > PIECE:
        end = text.rfind(b" ", at, at + PIECE)
        end = text.find(b" ", at + PIECE) if end < 0 else end
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for (lang, source), (n, docs) in held.items():
            cols[0].extend([lang] * (len(n) + 1))
            cols[1].extend([source] * (len(n) + 1))
            cols[2].extend([None, *n])
            cols[3].extend([0, *n.values()])
            cols[4].extend([0, *map(docs.__getitem__, n)])
        held.clear()
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([out[0], out[1], out[2].cast(pa.string()), *out[3:]], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, docs = held[lang, source]
                of: set[bytes] = set()
                for piece in terms(text):
                    n.update(piece)
                    of.update(piece)
                docs.update(of)
            if sum(len(n) for n, _ in held.values()) > ENTRIES:
                yield rows()
    yield rows()


def scaled(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / of) of whole numbers, three digits at a time, so that nothing leaves 64 bits while `of` is below 10^15."""
    whole, rest = np.divmod(count, of)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digits
    return whole + 1


def distances(p: np.ndarray) -> np.ndarray:
    """Sums over terms of |p - q| for all pairs of groups, by broadcasting as many rows and terms at once as TEMPORARY allows."""
    groups, n = p.shape
    out = np.zeros((groups, groups), np.int64)
    rows = max(1, min(groups, TEMPORARY // max(groups, 1)))
    step = max(1, TEMPORARY // (rows * max(groups, 1)))
    for i in range(0, groups, rows):
        for k in range(0, n, step):
            out[i : i + rows] += np.abs(p[i : i + rows, None, k : k + step] - p[None, :, k : k + step]).sum(axis=2)
    return out


def _tiles(smoothing: int, top: int):
    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        """One block's partial pair matrix and heaps. groups: every group of the language, with its sums and the language's."""
        names = groups.column("source").to_pylist()
        place = {x: i for i, x in enumerate(names)}
        lang = groups.column("lang")[0].as_py()
        v, all_n = groups.column("v")[0].as_py(), groups.column("lang_n")[0].as_py()
        coded = counts.column("term").combine_chunks().dictionary_encode()
        words = coded.dictionary.to_pylist()
        tile = np.zeros((len(names), len(words)), np.int64)
        tile[[place[x] for x in counts.column("said_by").to_pylist()], coded.indices.to_numpy(zero_copy_only=False)] = counts.column("times").to_numpy()
        p = scaled(tile + smoothing, groups.column("n").to_numpy()[:, None] + smoothing * v) if words else tile
        q = scaled(tile.sum(axis=0) + smoothing, np.int64(all_n + smoothing * v)) if words else tile.sum(axis=0)
        apart = distances(p)
        one, two = np.nonzero(~np.eye(len(names), dtype=bool))
        source, part, item, value = [names[i] for i in one], ["pair"] * len(one), [names[i] for i in two], apart[one, two].tolist()
        for i, name in enumerate(names):
            over = np.flatnonzero((tile[i] > 0) & (p[i] > q))
            for f, word in heapq.nsmallest(top, ((int(q[k] - p[i, k]), words[k]) for k in over)):
                source.append(name)
                part.append("term")
                item.append(word)
                value.append(-f)
        return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n of the kept terms of documents (text, lang, source), and a row with a null term for every group."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInArrow(trimmed(_count), "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counted.withColumn("docs", every).filter(F.col("term").isNull() | (F.col("docs") >= least)).select("lang", "source", "term", "n")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, smoothing: int = SMOOTHING, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the language's other sources, and the terms most used beyond the language's share."""
    kept = cut(kept_terms(docs, least))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.filter("term is not null").select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("sources")).join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    langs = cut(langs.select("lang", "lang_n", "v", F.greatest(F.lit(1), F.ceil(F.col("sources") * F.col("v") / cells)).cast("long").alias("blocks")))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    dealt = kept.filter("term is not null").join(langs, "lang").select(F.col("lang").alias("of"), block, F.col("source").alias("said_by"), "term", F.col("n").alias("times"))
    every = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "n", "lang_n", "v")
    found = dealt.groupBy("of", "block").cogroup(every.groupBy("lang", "block")).applyInArrow(_tiles(smoothing, top), "lang string, source string, part string, item string, value long")
    # a term lies in one block, so that its sum is itself
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_divergence(spark, sf_dir) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
tops AS (SELECT p.lang, source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""
