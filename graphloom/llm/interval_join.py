"""Interval overlap join: sales against the same client's click sessions, by nested containment lists.

Intervals are compared by slots, both ends inclusive; an open interval has no last slot. Of each client
shard a task holds the sessions as nested containment lists: a list's intervals rise in start and end
alike, and whatever lies within one of them forms a sublist below it. Open sessions, which all end alike
and so hold all that starts later, are the outer containers, one list by start. A sale binary-searches
each list that it meets: the intervals it overlaps are one run of the list, and each relation a run of
that, whose sums come from running totals. It descends below intervals that reach over one of its ends;
one that lies strictly inside it counts with all below.

Sessions of one client that have equal slots are one entry with a weight. As sessions don't overlap, a
client has three entries a slot at most, however many clicks it has; clicks meet by buckets of the gap's
length before they are shuffled by client. A client with over 1 / SHARES of all sales has them dealt to
several shards, each with all of its entries. Of such clients there are SHARES at most, which alone are
broadcast; a shard's size follows the number of rows by ROWS, not the session's settings.

Defined cases: rows without client or time give nothing; a repeated click changes nothing; a repeated
sale counts as often; sales with one sale_id are summed; a null sale_id is one group; lines without
sale_id belong to no sale; a sale without lines ends when it was sold; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import partitions, table

#: Microseconds between clicks of different sessions, at least; and of a slot.
GAP, SLOT = 600_000_000, 3_600_000_000
#: Microseconds of the spans that a client's clicks are first joined in.
DAY = 86_400_000_000
#: A client with over this share of all sales, and over LEAST, is dealt to several shards.
SHARES, LEAST = 1000, 2000
#: Rows of both sides that a shard holds, about.
ROWS = 200_000
#: By the sale's start (earlier, equal, later), then by its end (earlier, equal, later).
RELATIONS = (("overlaps", "finished_by", "contains"), ("starts", "equals", "started_by"), ("during", "finishes", "overlapped_by"))
NAMES = np.array([name for row in RELATIONS for name in row])


def micros(rows: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column; without a zone it is UTC, whatever the session's zone."""
    x = F.col(column)
    if dict(rows.dtypes)[column] == "timestamp":
        return F.unix_micros(x)
    clock = (F.hour(x) * 3600 + F.minute(x) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("long")
    return F.unix_date(x.cast("date")).cast("long") * 86_400_000_000 + clock


def floored(x: Column, by: int) -> Column:
    """x / by, rounded down; the division has no remainder, and is exact below 2^53."""
    return ((x - F.pmod(x, F.lit(by).cast("long"))) / F.lit(by)).cast("long")


def sessions(clicks: DataFrame, gap: int = GAP) -> DataFrame:
    """client_id, first, last (microseconds), open: a click over `gap` after the client's one before begins another.

    Clicks of one bucket of the gap's length always share a session, so a client has one row a bucket from
    then on, and `last` carries in its lowest bit whether a purchase is at that time. What a day's
    buckets join to is joined again by client.
    """
    seen = clicks.filter("client_id is not null and ts is not null").select(F.col("client_id").cast("long").alias("client_id"), micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).cast("long").alias("bought"))
    seen = seen.groupBy("client_id", floored(F.col("us"), gap).alias("bucket")).agg(F.min("us").alias("first"), F.max(F.col("us") * 2 + F.col("bought")).alias("last"))
    seen = seen.withColumn("day", floored(F.col("first"), DAY))
    # runs within a day first, so that a client's window holds what is left of its days, not its buckets
    for key in (("client_id", "day"), ("client_id",)):
        by_time = Window.partitionBy(*key).orderBy("first")
        near = F.col("first") - F.shiftright(F.lag("last").over(by_time), 1) <= gap
        seen = seen.withColumn("begins", F.when(near, 0).otherwise(1)).withColumn("session", F.sum("begins").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
        seen = seen.groupBy(*key, "session").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return seen.select("client_id", "first", F.shiftright("last", 1).alias("last"), (F.col("last") % 2 != 0).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sale_id, client_id, first, last (microseconds), open, times: equal rows of sales are one with their number."""
    sold = sales.filter("client_id is not null and sold_at is not null").select("sale_id", F.col("client_id").cast("long").alias("client_id"), micros(sales, "sold_at").alias("first"))
    sold = sold.groupBy("sale_id", "client_id", "first").agg(F.count("*").alias("times"))
    sent = lines.filter("sale_id is not null").groupBy("sale_id").agg(F.max(micros(lines, "shipped_at")).alias("sent"), F.max(F.col("shipped_at").isNull().cast("int")).alias("waits"))
    return sold.join(sent, "sale_id", "left").select("sale_id", "client_id", "first", F.greatest("first", "sent").alias("last"), (F.coalesce("waits", F.lit(0)) == 1).alias("open"), "times")


def slots(rows: DataFrame, slot: int = SLOT) -> DataFrame:
    """rows with start and stop, the slots of first and last; an open row's stop is null."""
    return rows.withColumn("start", floored(F.col("first"), slot)).withColumn("stop", F.when(~F.col("open"), floored(F.col("last"), slot)))


class Lists(NamedTuple):
    """Nested containment lists of many clients, one after the other; a list's number times `width` leads its keys."""

    starts: np.ndarray  #: rising keys by list and start
    stops: np.ndarray  #: of the same intervals, rising as well
    child: np.ndarray  #: the list below an interval, or -1
    parents: np.ndarray  #: places of the intervals with a list below
    sums: np.ndarray  #: running totals of weight, weight x start, weight x stop, crc
    below: np.ndarray  #: running totals of weight, weight x length, crc with all that lies below
    width: int


def nest(owner: np.ndarray, start: np.ndarray, stop: np.ndarray, weight: np.ndarray, crc: np.ndarray, width: int, clients: int) -> Lists:
    """The lists of distinct intervals (owner, start, stop), starts and stops from 0 below width; client i's outer list is list i.

    An interval lies within another exactly if it comes later by (start, -stop) and doesn't end after the
    latest end so far; those that lie in none are the list, and the rest go below the last of it before them.
    A round takes one depth.
    """
    order = np.lexsort((-stop, start, owner))
    start, stop, weight, crc = start[order], stop[order], weight[order], crc[order]
    todo, of, next_list = np.arange(len(order)), owner[order].astype(np.int64), clients
    child, places, lists, above = np.full(len(order), -1, np.int64), [], [], []
    parent = np.full(len(order), -1, np.int64)
    while len(todo):
        key = of * width + stop[todo]
        top = np.ones(len(todo), bool)
        top[1:] = key[1:] > np.maximum.accumulate(key)[:-1]
        places.append(todo[top])
        lists.append(of[top])
        rest = todo[~top]
        over = places[-1][(np.cumsum(top) - 1)[~top]]
        parent[rest] = over
        changes = np.ones(len(rest), bool)
        changes[1:] = over[1:] != over[:-1]
        of = next_list + np.cumsum(changes) - 1
        child[over[changes]] = of[changes]
        next_list += int(changes.sum())
        above.append(rest)
        todo = rest
    total = np.stack([weight, weight * (stop - start + 1), crc]).astype(np.int64)
    for level in places[:0:-1]:
        np.add.at(total, (slice(None), parent[level]), total[:, level])
    at, of = np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*lists, np.zeros(0, np.int64)])
    own = np.stack([weight, weight * start, weight * stop, crc]).astype(np.int64)[:, at]
    running = lambda x: np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(x, axis=1)], axis=1)
    return Lists(of * width + start[at], of * width + stop[at], child[at], np.flatnonzero(child[at] >= 0), running(own), running(total[:, at]), width)


def search(lists: Lists, outer: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, out: np.ndarray) -> None:
    """Adds to out (number, shared slots, crc by relation and query) what queries find from their outer lists down.

    a, b: the queries' slots; low, high: the same, drawn into the lists' range.
    """
    query, at = np.arange(len(a)), outer
    while len(query):
        base, lo_key, hi_key = at * lists.width, low[query], high[query]
        find = lambda keys, x, side: np.searchsorted(keys, base + x, side)  # noqa: B023, E731
        lo, hi = find(lists.stops, lo_key, "left"), find(lists.starts, hi_key, "right")
        hi = np.maximum(lo, hi)
        s1, s2 = (np.clip(find(lists.starts, lo_key, side), lo, hi) for side in ("left", "right"))
        e1, e2 = (np.clip(find(lists.stops, hi_key, side), lo, hi) for side in ("left", "right"))
        for i, (f, t) in enumerate(((s2, hi), (s1, s2), (lo, s1))):
            for j, (g, u) in enumerate(((e2, hi), (e1, e2), (lo, e1))):
                x, y = np.maximum(f, g), np.minimum(t, u)
                some = np.flatnonzero(x < y)
                if not len(some):
                    continue
                x, y, q = x[some], y[some], query[some]
                if (i, j) == (0, 2):
                    got = lists.below[:, y] - lists.below[:, x]
                else:
                    n, ns, ne, crc = lists.sums[:, y] - lists.sums[:, x]
                    got = np.stack([n, (ne if j == 2 else b[q] * n) - (ns if i == 0 else a[q] * n) + n, crc])
                np.add.at(out, (slice(None), 3 * i + j, q), got)
        # below those that aren't strictly inside: [lo, s2) and [max(s2, e1), hi)
        ends = np.searchsorted(lists.parents, np.stack([lo, np.minimum(s2, hi), np.maximum(s2, e1), hi]))
        number = np.stack([ends[1] - ends[0], np.maximum(ends[3] - ends[2], 0)])
        first = np.concatenate([ends[0], ends[2]])
        many = number.ravel()
        which = np.repeat(np.arange(len(many)), many)
        step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        at, query = lists.child[lists.parents[first[which] + step]], np.concatenate([query, query])[which]


def _ints(rows: pa.Table, column: str, null: int = 0) -> np.ndarray:
    return rows.column(column).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


SCHEMA = "sale_id long, relation string, n_pairs long, overlap_slots long, sessions_crc long"


def _meet(sales: pa.Table, held: pa.Table) -> pa.Table:
    """One shard's sales against its sessions."""
    clients, owner = np.unique(_ints(held, "client_id"), return_inverse=True)
    mine = _ints(sales, "client_id")
    at = np.searchsorted(clients, mine)
    known = np.flatnonzero(at < len(clients))
    known = known[clients[at[known]] == mine[known]]
    start, weight, crc = _ints(held, "start"), _ints(held, "n"), _ints(held, "crc")
    never = held.column("stop").is_null().combine_chunks().to_numpy(zero_copy_only=False)
    base = int(start.min()) if len(start) else 0
    start, stop = start - base, _ints(held, "stop") - base
    span = int(max(start.max(), stop[~never].max(initial=0))) + 1 if len(start) else 1
    at, a, b = at[known], _ints(sales, "start")[known] - base, _ints(sales, "stop")[known] - base
    waits = sales.column("stop").is_null().combine_chunks().to_numpy(zero_copy_only=False)[known]
    low, high = np.clip(a, -1, span), np.where(waits, span, np.clip(b, -1, span))
    # keys are from 0: -1 and span are beyond all slots
    width, out = span + 3, np.zeros((3, 9, len(known)), np.int64)
    shut = ~never
    closed = nest(owner[shut], start[shut] + 1, stop[shut] + 1, weight[shut], crc[shut], width, len(clients))
    search(closed, at, a + 1, b + 1, low + 1, high + 1, out)
    # the outer containers: open sessions by start; those that start up to the sale's end meet it
    order = np.lexsort((start[never], owner[never]))
    keys = (owner[never] * width + start[never] + 1)[order]
    own = np.stack([weight, weight * start, crc])[:, never][:, order]
    sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(own, axis=1)], axis=1)
    cuts = [np.searchsorted(keys, at * width + x, side) for x, side in ((0, "left"), (low + 1, "left"), (low + 1, "right"), (high + 1, "right"))]
    cuts[3] = np.maximum(cuts[3], cuts[2])
    for i, (x, y) in enumerate(((cuts[2], cuts[3]), (cuts[1], cuts[2]), (cuts[0], cuts[1]))):
        n, ns, c = sums[:, y] - sums[:, x]
        if i == 1:  # the sale's start may lie beyond the sessions' range
            n, ns, c = (np.where(low == a, v, 0) for v in (n, ns, c))
        shared = np.where(waits, 0, (b + 1) * n - (ns if i == 0 else a * n))
        for j, here in ((0, ~waits), (1, waits)):
            out[:, 3 * i + j] += np.stack([n, shared, c]) * here
    relation, sale = np.nonzero(out[0])
    n, shared, c = out[:, relation, sale] * _ints(sales, "times")[known[sale]]
    endless = waits[sale] & (relation % 3 == 1)
    return pa.table([sales.column("sale_id").combine_chunks().take(pa.array(known[sale])).cast(pa.int64()), pa.array(NAMES[relation].tolist(), pa.string()), pa.array(n), pa.array(shared, mask=endless), pa.array(c)], names=["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"])


def related(sales: DataFrame, held: DataFrame, rows: int) -> DataFrame:
    """SCHEMA of sales (sale_id, client_id, start, stop, times) against sessions (client_id, first, start, stop).

    rows: about how many both are together.
    """
    spark = sales.sparkSession
    entries = held.groupBy("client_id", "start", "stop").agg(F.count("*").alias("n"), F.sum(F.crc32(F.col("first").cast("string").cast("binary"))).alias("crc"))
    per = sales.groupBy("client_id").agg(F.count("*").alias("n"))
    share = max(LEAST, (per.agg(F.sum("n").alias("n")).first()["n"] or 0) // SHARES)
    shards = max(4 * partitions(spark), rows // ROWS)
    hot = [(r["client_id"], min(shards, -(-r["n"] // share))) for r in per.filter(F.col("n") > share).collect()]  # SHARES rows at most
    ways = F.broadcast(spark.createDataFrame(hot, "client_id long, ways long"))
    # a client's ways are shards side by side: two ways in one shard would meet all its entries twice
    shard = F.pmod(F.pmod(F.xxhash64("client_id"), F.lit(shards)) + F.col("way"), F.lit(shards)).cast("int").alias("shard")
    left = sales.join(ways, "client_id", "left").withColumn("way", F.pmod(F.xxhash64("sale_id", "start", "stop"), F.coalesce("ways", F.lit(1))).cast("long"))
    right = entries.join(ways, "client_id", "left").withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("ways", F.lit(1)) - 1)))
    left, right = left.select(shard, "sale_id", "client_id", "start", "stop", "times"), right.select(shard, "client_id", "start", "stop", "n", "crc")
    found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_meet, SCHEMA)
    return found.groupBy("sale_id", "relation").agg(*(F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "sessions_crc")))


def op13_interval_join(spark, sf_dir) -> DataFrame:
    clicks, sales, lines = (table(spark, sf_dir, x) for x in ("clicks", "sales", "sale_lines"))
    return related(slots(sale_intervals(sales, lines)), slots(sessions(clicks)), clicks.count() + sales.count())


SQL = """
WITH c AS (SELECT client_id, epoch_us(ts) AS us, kind FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY client_id ORDER BY us) <= 600000000 THEN 0 ELSE 1 END AS begins FROM c),
k AS (SELECT *, sum(begins) OVER (PARTITION BY client_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM b),
e AS (SELECT *, max(us) OVER (PARTITION BY client_id, session) AS latest FROM k),
s AS (SELECT client_id, min(us) AS first, max(us) AS last, bool_or(us = latest AND kind = 'purchase') IS TRUE AS open FROM e GROUP BY client_id, session),
h AS (SELECT client_id, first, first // 3600000000 AS a, CASE WHEN open THEN 1000000000 ELSE last // 3600000000 END AS b, open FROM s),
l AS (SELECT sale_id, max(epoch_us(shipped_at)) AS sent, bool_or(shipped_at IS NULL) AS waits FROM sale_lines GROUP BY sale_id),
q AS (SELECT sale_id, client_id, epoch_us(sold_at) // 3600000000 AS a, CASE WHEN coalesce(waits, false) THEN 1000000000 ELSE greatest(epoch_us(sold_at), coalesce(sent, epoch_us(sold_at))) // 3600000000 END AS b, coalesce(waits, false) AS open
  FROM sales LEFT JOIN l USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT q.sale_id, h.first, CASE WHEN q.a < h.a THEN CASE WHEN q.b < h.b THEN 'overlaps' WHEN q.b = h.b THEN 'finished_by' ELSE 'contains' END
    WHEN q.a = h.a THEN CASE WHEN q.b < h.b THEN 'starts' WHEN q.b = h.b THEN 'equals' ELSE 'started_by' END
    ELSE CASE WHEN q.b < h.b THEN 'during' WHEN q.b = h.b THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
    CASE WHEN NOT (q.open AND h.open) THEN least(q.b, h.b) - greatest(q.a, h.a) + 1 END AS shared
  FROM q JOIN h ON q.client_id = h.client_id AND q.a <= h.b AND h.a <= q.b),
t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS crc_table),
x AS (SELECT DISTINCT first, xor(list_reduce(list_transform(string_split(CAST(first AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, d: xor(c // 256, crc_table[xor(c, d) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM s, t)
SELECT sale_id, relation, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(shared) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc FROM p JOIN x USING (first) GROUP BY sale_id, relation"""
