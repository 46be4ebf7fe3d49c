"""Column functions on text: trimming, names, money, windows, markers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that a question's keyword search passes over
STOPWORDS = (
    "who", "is", "the", "a", "an", "what", "where", "when", "how",
    "does", "did", "do", "and", "or", "of", "in", "on", "for",
    "to", "was", "were", "are", "this", "that", "my", "his", "her",
)
# fixed values: names that stand for nobody
PLACEHOLDERS = ("author", "author of text", "the author", "writer", "the writer", "narrator")
# fixed values: what a name that is a clause holds
FRAGMENTS = ("results for", "reporting into", "adoption across", "coordination with", "continue to", "planning for", "team's", "'s results", "'s q")
MAX_NAME_WORDS = 5
# fixed values: what an answer that is none holds
NON_ANSWERS = ("no information", "not mention", "does not provide", "not available", "cannot determine", "no relevant information", "not possible to determine", "not specify")
# fixed values: element types by name
ELEMENT_TYPES = {
    "title": "heading", "heading": "heading", "header": "heading", "sectionheader": "heading",
    "table": "table",
    "text": "text", "narrativetext": "text", "listitem": "text", "list": "text", "footer": "text", "uncategorizedtext": "text",
}

_BLANK = r"[\s\p{Z}]"


def _is_seen(c: Column) -> Column:
    """Whether the first byte is that of an ASCII character that is seen."""
    return (c >= "!") & (c < "\x7f")


def strip(c: Column) -> Column:
    """Without white space at either end, for which a text that begins and ends with seen ASCII isn't searched."""
    return F.when(_is_seen(c) & _is_seen(F.substring(c, -1, 1)), c).otherwise(F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", ""))


def words(c: Column) -> Column:
    """Split on any white space, without empty words."""
    return F.filter(F.split(c, f"{_BLANK}+"), lambda w: w != "")


def label(c: Column) -> Column:
    """Letters, digits and underscores only; Entity if none are left."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")
    return F.when(c.rlike(r"^[A-Za-z0-9_]+\z"), c).when(kept == "", "Entity").otherwise(kept)


def relationship(c: Column) -> Column:
    kept = F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))
    return F.when(c.rlike(r"^[A-Z0-9_]+\z"), c).when(kept == "", "RELATED_TO").otherwise(kept)


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def element_type(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ELEMENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.replace(F.lower(c), F.lit(" "), F.lit(""))), F.lit("text"))


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start, piece>>: the whole text if it is short, else trimmed windows, empty ones dropped."""
    if not 0 <= overlap < size:
        raise ValueError(f"windows of {size} can't overlap by {overlap}")
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), strip(F.substring(text, i + 1, F.lit(size))).alias("piece")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), text.alias("piece")))
    return F.when(n <= size, one).otherwise(F.filter(cut, lambda x: x["piece"] != ""))


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """array<string>: windows of white-space tokens."""
    if not 0 <= overlap < size:
        raise ValueError(f"windows of {size} can't overlap by {overlap}")
    w = words(text)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size - overlap))
    many = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= size, F.array(F.array_join(w, " "))).otherwise(many)


def holds_any(c: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(c), m))


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(c)).isin(*PLACEHOLDERS)


def is_fragment(c: Column) -> Column:
    return (F.size(words(c)) > MAX_NAME_WORDS) | holds_any(strip(c), FRAGMENTS)


def is_non_answer(c: Column) -> Column:
    return holds_any(c, NON_ANSWERS)


def strip_role(c: Column) -> Column:
    """Without a leading `assistant:`."""
    return strip(F.regexp_replace(c, r"^assistant:\s*", ""))


def query_words(c: Column) -> Column:
    """Lower-case words but stop words and those of two letters or fewer; the whole question if none is left."""
    kept = F.filter(words(F.lower(c)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    return F.when(F.size(kept) == 0, F.array(F.lower(c))).otherwise(kept)


def join_facts(facts: Column) -> Column:
    return F.array_join(F.transform(facts, lambda x: F.concat(F.lit("- "), x)), "\n")


def join_chunks(chunks: Column) -> Column:
    return F.array_join(chunks, "\n\n---\n\n")


#: Stands for an empty context in evaluation.
NO_CONTEXT = "No context retrieved."


def split_facts(context: Column) -> Column:
    """The facts of a context, without their bullets; the placeholder if there are none."""
    lines = F.filter(F.transform(F.split(context, "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[- ]+", ""))), lambda x: x != "")
    return F.when(F.size(lines) == 0, F.array(F.lit(NO_CONTEXT))).otherwise(lines)


def split_chunks(context: Column) -> Column:
    parts = F.filter(F.transform(F.split(context, "\n\n---\n\n"), strip), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(F.lit(NO_CONTEXT))).otherwise(parts)
