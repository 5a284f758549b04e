"""WARC archives: writing records in segments, and putting them together again.

A page's record is an HTTP response whose body is its payload in chunked transfer framing. A block over ``segment`` bytes is cut
into a first record and continuation records, which may lie in other files. Of the pages with one payload, the largest page_id
is the response and the others are revisit records whose WARC-Refers-To is the record id of that response. Each record is a gzip
member of its own. Reading groups the continuation records by the identifier of their origin, orders them by segment number, checks
that none is missing and that the total length is right, decodes the framing, and finds the record that each revisit refers to.
Only segments are shuffled; whole records are decoded where they are read.

Files are written by Spark's committer, each from a bounded number of bytes. Defined results: a null or empty html is an empty
payload, always a response. Rows that repeat a page_id are written each; where they are the response, each is one, and revisits
refer to the first by URL. A row with a null page_id is a response and no other row refers to it. An empty table gives no archives
and an empty result."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redsieve.llm.blobs import read_blobs, write_blobs
from redsieve.llm.common import bounded, saved, shared_path

#: Fixed value: the least payload that is written as a revisit.
REVISIT_BYTES = 1000

#: Bytes of a block in one record, of a chunk of the framing, and of a file, about.
SEGMENT = 16_384
CHUNK = 4_096
FILE = 8 << 20

#: Name space of record ids, and the field, an extension, that holds a page's id.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/page-records")
PAGE_FIELD = "Page-ID"
#: A gzip member of no bytes, which ends each file.
_END = zlib.compress(b"", 6, wbits=31)
#: Bytes that are decompressed at once.
_WINDOW = 1 << 16

_DATE = "2024-01-01T00:00:00Z"  # archives of the same pages are the same bytes


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[k : k + size] for k in range(0, len(payload), size))) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0].strip(), 16)
        if n < 0:
            raise ValueError("a chunk's length is negative")
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(*of: object) -> str:
    return f"<{uuid.uuid5(_SPACE, ' '.join(map(str, of))).urn}>"


def records(own_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, sha1: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit if ``refers_to`` is a record's id, else a response."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    target = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", target)]
    page = [] if page_id is None else [(PAGE_FIELD, str(page_id))]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own_id), *common, *page, ("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", digest)]
        return [_record(fields, block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own_id), *common, *page, ("WARC-Payload-Digest", digest)]
    if len(block) <= segment:
        return [_record(fields, block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [_record([*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(own_id, k)), ("WARC-Segment-Origin-ID", own_id), ("WARC-Segment-Number", str(k)), *more, *common], part))
    return out


def _plain(data: bytes) -> bytes:
    """``data`` with its gzip members, one after the other, decompressed."""
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("a compressed file is cut off")
            out.append(member.decompress(data[at : at + _WINDOW]))
            at = min(len(data), at + _WINDOW) - len(member.unused_data)
    return b"".join([*out, data[at:]])


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record, of a file that may be compressed, whole or record by record; line
    feeds between and after records are skipped."""
    data = _plain(data)
    at, n = 0, len(data)
    while True:
        while at < n and data[at] in b"\r\n":
            at += 1
        if at >= n:
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        at = end + 4 + size
        if at > n:
            raise ValueError("a record is cut off")
        yield fields, data[end + 4 : at]


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, sha1, original (the page that a revisit refers to, null for responses) and copy: 0, or the number of
    the row among those that repeat a page_id and a payload.

    Only digests move: payloads stay with their rows, but for such repeated ones."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("sha1"))
    digests = saved(rows.where(F.col("bytes") >= REVISIT_BYTES).select("page_id", "bytes", "sha1"), "digests")
    groups = digests.groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a response for each group of equal payloads, which are few rows next to all pages
    alike = saved(digests.join(groups, ["sha1", "bytes"]).groupBy("page_id", "sha1").agg(F.first("first").alias("first"), F.count("*").alias("n")), "alike")
    others = saved(alike.where("page_id < first").select("page_id", "sha1", F.col("first").alias("original")), "revisits")
    rows = rows.withColumn("copy", F.lit(0))
    again = alike.where("page_id = first and n > 1").select("page_id", "sha1")
    if not again.isEmpty():
        again = bounded(again)
        number = F.row_number().over(Window.partitionBy("page_id", "sha1").orderBy("url")) - 1
        numbered = rows.join(again, ["page_id", "sha1"], "left_semi").withColumn("copy", number)
        rows = rows.join(again, ["page_id", "sha1"], "left_anti").unionByName(numbered)
    return rows.join(bounded(others), ["page_id", "sha1"], "left").select("page_id", "url", "html", "bytes", "sha1", "original", "copy")


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, file: int = FILE) -> None:
    """The pages of ``with_originals`` as WARC files under ``path``."""
    columns = ("page_id", "url", "html", "bytes", "sha1", "original", "copy")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        for batch in batches:
            for page_id, url, html, n, sha1, original, copy in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                number += 1
                # others refer to the first copy, whose id they know; the other ids are of the place of the row
                known = page_id is not None and n >= REVISIT_BYTES and original is None and not copy
                own = record_id(page_id, sha1) if known else record_id(page_id, sha1, task, number)
                refers_to = None if original is None else record_id(original, sha1)
                for r in records(own, page_id, url, (html or "").encode(), refers_to, sha1, segment):
                    held.append(zlib.compress(r, 6, wbits=31))
                    size += len(held[-1])
                    if size >= file:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])

    write_blobs(pages.select(*columns).mapInArrow(write, "file binary"), "file", path, end=_END)


#: What a whole record gives: target is the id of the record that a revisit refers to.
_OUT = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("url", pa.string())])
_ROW = "record string, page_id long, payload_bytes long, payload_digest string, record_type string, target string, url string"


def _decoded(fields: dict[str, str], block: bytes) -> tuple:
    """A row of _OUT for a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    page = fields.get(PAGE_FIELD.lower())
    own, page = fields["warc-record-id"], None if page is None else int(page)
    if fields["warc-type"] == "revisit":
        return own, page, int(headers["content-length"]), digest, "revisit", fields["warc-refers-to"], fields["warc-target-uri"]
    payload = dechunked(body) if headers.get("transfer-encoding") == "chunked" else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{own}: the payload isn't that of its digest")
    return own, page, len(payload), digest, "response", None, fields["warc-target-uri"]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record, page_id, payload_bytes, payload_digest, record_type, target, url of every response and revisit in the files under
    ``path``; segments are put together first."""
    part = pa.schema([*_OUT, ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [None] * len(_OUT)
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for fields, block in parsed(batch["content"][k].as_buffer().to_pybytes()):
                    if fields["warc-type"] == "continuation":
                        rows.append((*none, fields["warc-segment-origin-id"], int(fields["warc-segment-number"]), int(fields.get("warc-segment-total-length", -1)), None, block))
                    elif "warc-segment-number" in fields:
                        head = "\n".join(f"{k}: {v}" for k, v in fields.items())
                        rows.append((*none, fields["warc-record-id"], int(fields["warc-segment-number"]), -1, head, block))
                    elif fields["warc-type"] in ("response", "revisit"):
                        rows.append((*_decoded(fields, block), None, None, None, None, None))
                    if len(rows) == 1000:
                        yield _batch(rows, part)
                        rows = []
                yield _batch(rows, part)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, segments in zip(batch["origin"].to_pylist(), batch["segments"].to_pylist(), strict=True):
                numbers = [s["segment"] for s in segments]
                if numbers != list(range(1, len(numbers) + 1)):
                    raise ValueError(f"{origin}: its segments are {numbers}")
                block = b"".join(s["block"] for s in segments)
                if segments[-1]["total"] != len(block):
                    raise ValueError(f"{origin}: {len(block)} bytes, its last segment says {segments[-1]['total']}")
                fields = dict(x.partition(": ")[::2] for x in segments[0]["head"].split("\n"))
                rows.append(_decoded(fields, block))
            yield _batch(rows, _OUT)

    # read once: whole records as rows, segments as they are
    found = saved(read_blobs(spark, path).mapInArrow(read, f"{_ROW}, origin string, segment long, total long, head string, block binary"), "records")
    # as many bytes as the record that was cut has
    groups = found.where("origin is not null").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "total", "head", "block"))).alias("segments"))
    return found.where("origin is null").select(*_OUT.names).unionByName(saved(groups.mapInArrow(join, _ROW), "joined"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record in the files under ``path``. A revisit of
    a record that isn't there is an error."""
    rows = read_records(spark, path)
    wanted = saved(rows.where("target is not null").select(F.col("target").alias("record")).distinct(), "targets")
    found = saved(rows.where("target is null").join(bounded(wanted), "record", "left_semi").select(F.col("record").alias("target"), F.col("page_id").alias("refers_to"), F.lit(True).alias("there")), "found")
    lost = F.col("target").isNotNull() & F.col("there").isNull()
    refers_to = F.when(lost, F.raise_error(F.concat(F.lit("no record is "), "target")).cast("long")).otherwise(F.col("refers_to"))
    return rows.join(bounded(found), "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", refers_to.alias("refers_to"), "url")


def archived(pages: DataFrame, **parameters) -> DataFrame:
    """Writes the archives of ``pages`` in the shared folder and reads them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(with_originals(pages), path, **parameters)
    return read_archives(pages.sparkSession, path)


ORACLE = """
with p as (
  select page_id, url, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
q as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < first then first end as refers_to, coalesce(url, '') as url
from q
"""
