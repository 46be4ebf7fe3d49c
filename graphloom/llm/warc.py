"""WARC archives: writing with segmentation and revisit records, and reading with reassembly.

Each record is a gzip member of its own, so that an archive can be read from any record on.
Archives are written by Spark's own text writer, whose line end is an empty gzip member, and read by
its binaryFile reader, so any store that Spark reaches will do. A record's HTTP body is in chunked
framing. A body over SEGMENT bytes is cut: the response record carries segment 1 and continuation
records the rest. So a file's size is bounded by RECORDS_PER_FILE records of about SEGMENT bytes, and
a reader holds a file as it is stored and one record. It groups continuation records by the origin's
record id, orders them by segment number, verifies numbers and total length, and only then decodes
the chunks.

Defined cases: a null html is an empty payload; a null url is `urn:page:<id>`; rows with the same
page_id (or none) are told apart by their digest and their ordinal among themselves; pages of one
payload without any page_id are all responses; an incomplete or damaged
segment chain raises ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import cut, shared_folder

SEGMENT = 8 * 1024
CHUNK = 4096
MIN_SHARED = 1000
RECORDS_PER_FILE = 2048
SALTS = 64
_NONE = -(1 << 63)  #: stands for a null page_id in joins
#: An empty gzip member: what the text writer puts behind each record.
_NOTHING = gzip.compress(b"", mtime=0).decode("latin-1")
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked framing."""
    out = [b"%x\r\n%b\r\n" % (len(part), part) for i in range(0, len(payload), size) if (part := payload[i : i + size])]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over. ValueError if it is damaged."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without size line")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than stated")
        out.append(data[at : at + size])
        at += size + 2


def record_id(page_id: int | None, sha: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}:{nth}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def page_records(page_id, nth: int, url: str | None, payload: bytes, kind: str, refers_to, segment: int = SEGMENT) -> Iterator[bytes]:
    """A page's records, without the two line ends behind each."""
    digest = hashlib.sha1(payload)
    sha1 = "sha1:" + base64.b32encode(digest.digest()).decode()
    me = record_id(page_id, digest.hexdigest(), nth)
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Target-URI", uri), ("WARC-Date", _DATE), ("WARC-Payload-Digest", sha1), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if kind == "revisit":
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(refers_to, digest.hexdigest(), 1)), ("X-Refers-To-Page-Id", str(refers_to)), ("Content-Type", "application/http; msgtype=response")], head)
        return
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [body[i : i + segment] for i in range(0, len(body), segment)]
    for i, part in enumerate(parts):
        seg = [] if len(parts) == 1 else [("WARC-Segment-Number", str(i + 1))]
        if i == 0:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, *seg, ("Content-Type", "application/http; msgtype=response")], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(body)))] if i == len(parts) - 1 else []
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{me}:{i}')}>"), ("WARC-Segment-Origin-ID", me), *common[:2], *seg, *last], part)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record", pa.binary())])
    for batch in batches:
        out, size = [], 0
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
            for rec in page_records(get("page_id"), get("nth"), get("url"), (get("html") or "").encode(), get("record_type"), get("refers_to")):
                out.append(gzip.compress(rec + b"\r\n\r\n", 6, mtime=0))
                size += len(out[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)


def plan_records(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """pages with nth, record_type and refers_to: of equal payloads of min_shared bytes the largest page_id is the response.

    The decision is made on digests; a digest's rows are joined with it in SALTS parts.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = pages.select("page_id", F.sha1(data).alias("sha"), F.octet_length(data).cast("long").alias("len"))
    keys = cut(keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))))
    part = keys.filter(F.col("len") >= min_shared).groupBy("sha", "len", "salt").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    whole = part.groupBy("sha", "len").agg(F.max("top").alias("top"), F.sum("n").alias("n")).filter("n > 1")
    roles = part.select("sha", "len", "salt").join(whole, ["sha", "len"])
    revisits = keys.join(roles, ["sha", "len", "salt"]).select(F.coalesce("page_id", F.lit(_NONE)).alias("key"), "sha", "top").distinct()
    rows = pages.select("page_id", "url", "html", F.coalesce("page_id", F.lit(_NONE)).alias("key"), F.sha1(data).alias("sha"))
    # the join's partitioning serves the window, so that html is shuffled once
    rows = rows.join(revisits, ["key", "sha"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("key", "sha").orderBy("url")))
    revisit = F.col("top").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("top")) & (F.col("nth") == 1))
    return rows.select("page_id", "url", "html", "sha", "nth", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_warc(planned: DataFrame, path: str) -> None:
    """Writes planned pages as WARC files of gzip members under path."""
    rows = planned.select("page_id", "nth", "url", "html", "record_type", "refers_to")
    records = rows.mapInArrow(_encode, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", _NOTHING).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS_PER_FILE).mode("overwrite").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of an archive's records."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("record of another length than stated")
        yield headers, block
        at = end + 8 + size


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of gzip members that hold anything, one at a time; plain data is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("gzip member without its end")
            out.append(one.decompress(data[at : at + step]))
            at += min(step, len(data) - at) - len(one.unused_data)
        if whole := b"".join(out):
            yield whole


_PARSED = "record_id string, page_id long, record_type string, refers_to long, digest string, segment int, total long, origin string, block binary"
_PARSED_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("origin", pa.string()), ("block", pa.binary())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x else None
    for batch in batches:
        for cell in batch.column("content"):
            data = cell.as_buffer().to_pybytes()
            rows, size = [], 0
            for h, block in (record for member in members(data) for record in parse_records(member)):
                me = h["warc-record-id"]
                rows.append((me, number(h.get("x-page-id")), h["warc-type"], number(h.get("x-refers-to-page-id")), h.get("warc-payload-digest"), number(h.get("warc-segment-number")), number(h.get("warc-segment-total-length")), h.get("warc-segment-origin-id", me), block))
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARSED_ARROW)], schema=_PARSED_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARSED_ARROW)], schema=_PARSED_ARROW)


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (segment number, total length, bytes), in any order; ValueError if one is missing."""
    parts = sorted(parts, key=lambda x: x[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or repeated")
    whole = b"".join(p[2] for p in parts)
    if parts[-1][1] != len(whole):
        raise ValueError(f"segments have {len(whole)} bytes, the last states {parts[-1][1]}")
    return whole


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
_PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def _page(page_id, kind: str, refers_to, digest: str, block: bytes) -> tuple:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    stated = base64.b32decode(digest.partition(":")[2]).hex()
    if kind == "revisit":
        return page_id, int(fields[b"content-length"]), stated, kind, refers_to, None
    payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    if (found := hashlib.sha1(payload).hexdigest()) != stated:
        raise ValueError(f"page {page_id}: digest {found}, stated {stated}")
    return page_id, len(payload), found, kind, None, payload.decode()


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many = "segments" in batch.schema.names
        rows, size = [], 0
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
            block = reassembled([(s["segment"], s["total"], s["block"]) for s in get("segments")]) if many else get("block")
            rows.append(_page(get("page_id"), get("record_type"), get("refers_to"), get("digest"), block))
            size += len(block)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGE_ARROW)], schema=_PAGE_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGE_ARROW)], schema=_PAGE_ARROW)


def read_warc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, html of the pages in the archives under path.

    Whole records are decoded where they are read. Segmented ones alone are shuffled, by the
    origin's record id; such a group is one page. A revisit's html is null: it is its response's.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = files.mapInArrow(_parse, _PARSED)
    whole = parsed.filter("segment is null").mapInArrow(_decode, _PAGE)
    groups = parsed.filter("segment is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"), F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"), F.collect_list(F.struct("segment", "total", "block")).alias("segments")
    )
    return whole.unionByName(groups.mapInArrow(_decode, _PAGE))


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM w
"""


def op4_warc(spark, sf_dir) -> DataFrame:
    """Archives go to a new folder under the shared checkpoint folder."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    planned = plan_records(pages)
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    write_warc(planned, path)
    return read_warc(spark, path).drop("html")
