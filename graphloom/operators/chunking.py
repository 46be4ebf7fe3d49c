"""Layout-aware chunking of documents' elements, with windows over ordered elements.

elements: doc, pos, type, text, page_number, bbox. Sections come from headings; where a document
has none, a text buffer ends at a new page or a wide vertical gap. Tables and headings are chunks of
their own. A window's page and box are those of the element that holds its first character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import strip, windows
from graphloom.settings import DEFAULTS

#: Vertical space, in points, over which two elements are apart.
GAP = 40.0


def sections(elements: DataFrame) -> DataFrame:
    """elements with has_headings and section, the heading that applies at each."""
    doc = Window.partitionBy("doc")
    so_far = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("type") == "heading"
    return elements.withColumn("has_headings", F.max(heading.cast("int")).over(doc) == 1).withColumn("section", F.last(F.when(heading, strip(F.col("text"))), ignorenulls=True).over(so_far))


def islands(elements: DataFrame) -> DataFrame:
    """Non-blank elements with section, kind (text, table or heading) and island, the number of their run in doc.

    A gap is judged against the last text of the buffer: blanks are passed over, and a table or
    heading in between starts anew.
    """
    found = sections(elements).filter((strip(F.col("text")) != "") | F.col("type").isin("heading", "table"))
    w = Window.partitionBy("doc").orderBy("pos")
    text = ~F.col("type").isin("heading", "table")
    before = F.lag(F.struct(text.alias("text"), "page_number", "bbox")).over(w)
    found = found.withColumn("_b", before)
    new_page = ~F.col("page_number").eqNullSafe(F.col("_b.page_number"))
    apart = F.coalesce(F.get("bbox", F.lit(1)) - F.get("_b.bbox", F.lit(3)) > GAP, F.lit(False))
    start = F.col("_b").isNull() | ~text | ~F.col("_b.text") | (~F.col("has_headings") & (new_page | apart))
    return found.withColumn("island", F.sum(start.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("kind", F.when(text, "text").otherwise(F.col("type"))).drop("_b")


def chunks(elements: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """doc, island, start, type, text, page_number, bbox, section, in order of (doc, island, start); no blank ones."""
    runs = islands(elements)
    ahead = Window.partitionBy("doc", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("offset", F.coalesce(F.sum(F.length("text").cast("long") + 1).over(ahead), F.lit(0).cast("long")))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text", "page_number", "bbox", "offset")))
    whole = runs.groupBy("doc", "island", "kind").agg(parts.alias("parts"), F.max(F.struct("pos", "section"))["section"].alias("section"))
    whole = whole.withColumn("offsets", F.transform("parts", lambda p: p["offset"])).withColumn("joined", F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    text = F.col("joined")
    cut = F.when(F.col("kind") == "text", windows(text, size, overlap)).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.when(F.col("kind") == "heading", strip(text)).otherwise(text).alias("piece"))))
    each = whole.select("doc", "island", "kind", "section", "parts", "offsets", F.inline(cut))
    at = F.get("parts", F.size(F.filter("offsets", lambda o: o <= F.col("start"))) - 1)
    out = each.select("doc", "island", "start", F.col("kind").alias("type"), F.col("piece").alias("text"), at["page_number"].alias("page_number"), at["bbox"].alias("bbox"), "section")
    return out.filter(strip(F.col("text")) != "")


#: Characters of chunks that a worker holds before it hands them over.
HELD = 1 << 20
#: A sentence ends at a full stop, question or exclamation mark before white space; a paragraph at a blank line.
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n\s*")


def words_as_tokens() -> Callable[[list[str]], list[int]]:
    """The default counter: white-space words."""
    return lambda texts: [len(x.split()) for x in texts]


def packed(lengths: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of runs of whole pieces with these lengths, each of `budget` at most unless one piece alone is longer.

    A run takes pieces as long as they fit. The next begins with as many of the last pieces as `overlap`
    allows and leave room for a new one.
    """
    out, first, end, used = [], 0, 0, 0
    while end < len(lengths):
        while end < len(lengths) and (end == first or used + lengths[end] <= budget):
            used += lengths[end]
            end += 1
        out.append((first, end))
        if end == len(lengths):
            break
        kept, again = 0, end
        while again > first + 1 and kept + lengths[again - 1] <= overlap and kept + lengths[again - 1] + lengths[end] <= budget:
            again -= 1
            kept += lengths[again]
        first, used = again, kept
    return out


def sentences(text: str, count: Callable[[list[str]], list[int]], budget: int) -> tuple[list[str], list[int]]:
    """The text's sentences and their lengths in tokens; one over the budget falls into runs of words, and such a word into halves."""
    out: list[str] = []
    lengths: list[int] = []
    for one in (x for x in SENTENCE.split(text) if x and not x.isspace()):
        todo = [one.strip()]
        (n,) = count(todo)
        if n > budget:
            words = todo[0].split()
            parts = packed(count(words), budget, 0)
            todo = [" ".join(words[i:j]) for i, j in parts]
        while todo:
            piece = todo.pop(0)
            (n,) = count([piece])
            if n > budget and len(piece) > 1:
                middle = len(piece) // 2
                space = piece.rfind(" ", 0, middle)
                at = space if space > 0 else middle
                todo[:0] = [x for x in (piece[:at].strip(), piece[at:].strip()) if x]
                continue
            out.append(piece)
            lengths.append(n)
    return out, lengths


def sentence_chunks(docs: DataFrame, tokens: Callable[[], Callable[[list[str]], list[int]]], budget: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """doc, place, text, tokens: docs (doc, text) in chunks of whole sentences within a budget of tokens, joined by spaces, with an overlap by whole sentences.

    tokens: makes, once a worker, what counts the tokens of texts. A sentence over the budget is cut
    between words, a word over it between characters. A chunk's tokens are those of its text, which
    may be fewer; where joining makes more, it is halved. A null or blank text has no chunks.
    """
    if not 0 <= overlap < budget:
        raise ValueError(f"chunks of {budget} can't overlap by {overlap}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens()
        for batch in batches:
            docs_, texts = batch.column("doc"), batch.column("text")
            rows: list[tuple[int, int, str, int]] = []
            held = 0
            for i in range(batch.num_rows):
                parts, lengths = sentences(texts[i].as_py() or "", count, budget)
                place, first, end = 0, 0, 0
                for first, end in packed(lengths, budget, overlap):
                    for text in _within(parts[first:end], count, budget):
                        rows.append((i, place, *text))
                        place, held = place + 1, held + len(text[0])
                        if held >= HELD:
                            yield _told(docs_, rows)
                            rows, held = [], 0
            yield _told(docs_, rows)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "text").mapInArrow(run, f"doc {kind}, place long, text string, tokens long")


def _told(docs: pa.Array, rows: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
    at = pa.array([r[0] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([docs.take(at), *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.string()), (3, pa.int64())))], names=["doc", "place", "text", "tokens"])


def _within(parts: list[str], count: Callable[[list[str]], list[int]], budget: int) -> Iterator[tuple[str, int]]:
    """The parts joined by spaces, halved where joining takes them over the budget."""
    text = " ".join(parts)
    (n,) = count([text])
    if n <= budget or len(parts) == 1:
        yield text, n
    else:
        yield from _within(parts[: len(parts) // 2], count, budget)
        yield from _within(parts[len(parts) // 2 :], count, budget)


def heading_spans(spans: DataFrame) -> DataFrame:
    """Text blocks (doc, page, block, text, size, bold) with is_heading, judged by size against the page's median, or by bold.

    A block is a heading if its size is over 1.15 times the median (the upper of two middle ones), or
    if it is bold, has 120 characters at most, and fewer than 60 % of the page's blocks are bold.
    """
    page = spans.groupBy("doc", "page").agg(F.sort_array(F.collect_list("size")).alias("sizes"), F.avg(F.col("bold").cast("double")).alias("bold_share"))
    page = page.select("doc", "page", F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")).alias("median"), "bold_share")
    found = spans.join(page, ["doc", "page"])
    large = F.col("size") > 1.15 * F.col("median")
    return found.withColumn("is_heading", large | ((F.col("bold_share") < 0.6) & F.col("bold") & (F.length("text") <= 120)))


def bounding_box(points: str) -> F.Column:
    """[x0, y0, x1, y1] of an array of points (x, y)."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def table_text(rows: str) -> F.Column:
    """Cells joined by ` | `, rows by line feeds; a null cell is empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
