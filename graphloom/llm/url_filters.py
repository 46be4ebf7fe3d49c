"""URL filters: rules by host and path, and gradient-boosted trees on lexical features where no rule fits.

A rule names a host, which it fits with all subdomains, and the beginning of a path; the longest that fits
decides. The trees learn from labelled URLs (which the query takes to be those that a rule decides) what
the labels say of the shape of a URL: its length, depth, share of digits, entropy, parameters, and what
was labelled under its suffix. A level of a tree is one aggregation of the gradients by (node, feature,
bin), in whole micro-units, so that reruns agree; the finished trees are a column expression.

All is DataFrame operations. The trees are fitted on a bounded sample of the labelled URLs, those with
the smallest hashes; histograms, thresholds and suffixes that come to the driver are bounded by
parameters. Every URL is judged.

Defined cases: a null URL, or one without ://, has an empty host and path, which no rule fits; a URL
without labelled ones of both kinds beside it is judged by the kind there is, and allowed without any;
repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import cut, table

#: action and rule, as the audit's contract names them
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs that the trees are fitted on, at most; suffixes with a share of their own, and labelled URLs that such a one has.
SAMPLE, SUFFIXES, SUFFIX_LEAST = 20_000, 64, 10
#: Trees, their depth, bins of a feature, weight of a step, and what is added to a leaf's second derivatives.
TREES, DEPTH, BINS, STEP, RIDGE = 12, 3, 16, 0.3, 1.0
MICRO = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls. rules: (action, rule), a stated list."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def suffix(host: Column) -> Column:
    """The last label of the host."""
    return F.regexp_extract(host, r"[^.]*$", 0)


def entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, ch: s + _plogp((n - F.length(F.replace(text, ch, F.lit("")))).cast("double")))
    return F.when(n > 0, F.log2(n) - bits / n).otherwise(0.0)


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _number(text: Column, what: str) -> Column:
    """How many characters of the text lie in the class `what`."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{what}]", ""))




def features() -> dict[str, Column]:
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _number(path, "/"),
        "labels": _number(host, "."),
        "hyphens": _number(host, "-"),
        "digits": F.try_divide(_number(url, "0-9").cast("double"), F.length(url)),
        "entropy": entropy(url),
        "host_entropy": entropy(host),
        "parameters": F.when(query == "", 0).otherwise(1 + _number(query, "&")),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
    }


def shaped(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the features as doubles, and the host's suffix."""
    return urls.withColumn("url", F.coalesce("url", F.lit(""))).withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in features().items()} | {"suffix": suffix(F.col("host"))})


class Trees:
    """What was learned: shares of blocked URLs by suffix, and trees over them and the features; `margin` is a column."""

    def __init__(self, shares: dict[str, tuple[float, float]], other: tuple[float, float], start: float):
        self.shares, self.other, self.start, self.trees = shares, other, start, []

    def inputs(self) -> dict[str, Column]:
        """Of a row of `shaped`: what the trees ask of a suffix, the share blocked and how many were labelled."""
        held = [F.lit(self.other[0]), F.lit(self.other[1])]
        if self.shares:
            of = F.create_map(*(x for k, v in sorted(self.shares.items()) for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))))
            held = [F.coalesce(F.get(F.try_element_at(of, F.col("suffix")), F.lit(i)), held[i]) for i in (0, 1)]
        return {"f_suffix_share": held[0], "f_suffix_known": held[1]}

    @staticmethod
    def value(tree) -> str:
        """SQL of a tree: a leaf's number, or (feature, threshold, tree at most, tree above)."""
        if isinstance(tree, float):
            return f"{tree!r}D"
        feature, threshold, below, above = tree
        return f"IF({feature} <= {threshold!r}D, {Trees.value(below)}, {Trees.value(above)})"

    def margin(self) -> Column:
        return F.expr(" + ".join([f"{self.start!r}D", *map(Trees.value, self.trees)]))


def sampled(rows: DataFrame, size: int) -> DataFrame:
    """About size rows, those with the smallest hashes, at most size; fewer than twice as many reach the last task."""
    n = rows.count()
    h = F.pmod(F.xxhash64("url", "page_id"), F.lit(MICRO))
    near = rows if n <= 2 * size else rows.filter(h < math.ceil(2 * size * MICRO / n))
    return near.orderBy(F.xxhash64("url", "page_id")).limit(size)


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, sample: int = SAMPLE) -> Trees:
    """The trees for labelled URLs (page_id, url, host, path, blocked)."""
    rows = cut(shaped(sampled(labelled, sample)).withColumn("blocked", F.col("blocked").cast("int")))
    by = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")).cache()
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")).first()
    prior = (total["blocked"] + 0.5) / (total["n"] + 1)
    share = lambda n, blocked: ((blocked + prior) / (n + 1), math.log1p(n))
    known = by.filter(F.col("n") >= SUFFIX_LEAST).orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect()
    by.unpersist()
    model = Trees({r["suffix"]: share(r["n"], r["blocked"]) for r in known}, share(0, 0), math.log(prior / (1 - prior)) if total["n"] else -1.0)
    if not 0 < total["blocked"] < total["n"]:
        return model
    names = [f"f_{k}" for k in features()] + ["f_suffix_share", "f_suffix_known"]
    rows = rows.withColumns(model.inputs())
    cuts = rows.agg(*(F.percentile_approx(n, [i / bins for i in range(1, bins)], 10_000).alias(n) for n in names)).first()
    cuts = {n: sorted(set(cuts[n])) for n in names}
    rows = cut(rows.select(*names, "blocked", F.array(*(_bin(F.col(n), cuts[n]) for n in names)).alias("bins")))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        now = rows.withColumn("g", F.round((p - F.col("blocked")) * MICRO).cast("long")).withColumn("h", F.round(p * (1 - p) * MICRO).cast("long"))
        tree = _grow(now, names, cuts, depth)
        if isinstance(tree, float):
            break
        model.trees.append(tree)
    return model


def _bin(x: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds lie below x."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t < x))


def _grow(rows: DataFrame, names: list[str], cuts: dict, depth: int):
    """One tree, level by level; a level's histograms come to the driver, nodes x features x bins rows."""
    splits: dict[int, tuple[str, float]] = {}
    leaves: dict[int, float] = {}
    node, open_nodes = "0", [0]
    for level in range(depth):
        held = rows.withColumn("node", F.expr(node)).filter(F.col("node").isin(open_nodes))
        found = held.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        hist: dict[int, dict[int, dict]] = {}
        for r in found:
            hist.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
        open_nodes, moves = [], []
        for k, of in sorted(hist.items()):
            if (best := _best(of, names, cuts)) is None:
                leaves.setdefault(k, _step(*(sum(x[i] for x in of[0].values()) for i in (0, 1))))
                continue
            splits[k], sides = best
            moves.append(f"WHEN {k} THEN IF({splits[k][0]} <= {splits[k][1]!r}D, {2 * k + 1}, {2 * k + 2})")
            open_nodes += [2 * k + 1, 2 * k + 2]
            leaves |= {2 * k + 1: _step(*sides[0]), 2 * k + 2: _step(*sides[1])}
        if not open_nodes:
            break
        node = f"CASE {node} {' '.join(moves)} ELSE -1 END"

    def built(k: int):
        return (*splits[k], built(2 * k + 1), built(2 * k + 2)) if k in splits else leaves[k]

    return built(0)


def _step(g: int, h: int) -> float:
    return -STEP * g / (h + RIDGE * MICRO)


def _best(of: dict[int, dict], names: list[str], cuts: dict) -> tuple[tuple[str, float], tuple] | None:
    """The (feature, threshold) of the greatest gain, the first of equals, and the sums of either side; None without gain."""
    g, h = (sum(x[i] for x in of[0].values()) for i in (0, 1))
    worth = lambda g, h: g * g / (h + RIDGE * MICRO)
    score, best = worth(g, h) + 1, None
    for feature, at in sorted(of.items()):
        left = (0, 0)
        for b, threshold in enumerate(cuts[names[feature]]):
            left = tuple(x + y for x, y in zip(left, at.get(b, (0, 0)), strict=True))
            right = (g - left[0], h - left[1])
            if left[1] > 0 and right[1] > 0 and worth(*left) + worth(*right) > score:
                score, best = worth(*left) + worth(*right), ((names[feature], float(threshold)), (left, right))
    return best


def judged(urls: DataFrame, model: Trees, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block) of urls (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = shaped(urls.select("page_id", "url").withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))}))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns(model.inputs()).withColumns({"rule": rule, "action": action, "score": F.round(1 / (1 + F.exp(-model.margin())), 6)})
    return rows.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def by_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, blocked of the URLs that a rule decides: the labelled ones of the query."""
    host, path = host_and_path(F.col("url"))
    rows = urls.select("page_id", "url").withColumns({"host": host, "path": path})
    return rows.withColumn("blocked", ruled(F.col("host"), F.col("path"), rules)[1] == "block").filter("blocked is not null")


def op11_url_filters(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, fit(by_rules(pages)))
