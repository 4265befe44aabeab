"""Web archives: pages become WARC records in gzip files, and the files are read back as a table of chunks.

Writing: a payload longer than ``CHUNK_BYTES`` is cut into segments, each a record of its own (WARC-Segment-Number, the
later ones of type ``continuation``), so neither side ever holds a second copy of a long record.  Every segment carries
the digest of the payload up to its end.  Records are lines of Spark's text writer: a record ends with two line
breaks, which is the writer's line separator, so the files work on any store that Spark writes to.  All segments of a page
are one row of the writer and so stand in one file.

Copies: of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the response, the
others are revisits, which hold no payload but the digest, the length and the response's id.

Reading: archives are unpacked piece by piece; the result has a row for each segment with the running digest, and the
last one of a record (``last``) has the digest of the whole payload, recomputed from the bytes.

Defined results: a null payload is empty; null and repeated ids make records of their own (a null id is always a
response, and so are repeated rows of the smallest id); line breaks and other control signs in addresses are
percent-encoded; an empty table makes an archive without records.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import slices, table
from textfacts.session import work_path

CHUNK_BYTES = 64 << 10
MIN_REVISIT_BYTES = 100
#: Rows of the text writer, which are whole pages.
RECORDS_PER_FILE = 20_000
_BREAK = "\r\n"
_DATE = "2000-01-01T00:00:00Z"
_UNPACK = 1 << 18
_CONTROL = re.compile(r"[\x00-\x20\x7f]")

CHUNKS = "page_id long, chunk_no int, chunk_bytes long, running_digest string, last boolean, record_type string, refers_to long, payload_bytes long, declared_digest string"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _record(fields: list[tuple[str, str]], body: str) -> str:
    head = _BREAK.join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields)])
    return f"{head}{_BREAK}{_BREAK}{body}"


def _cuts(payload: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of the segments, none inside a character."""
    start = 0
    while True:
        stop = min(len(payload), start + size)
        while stop < len(payload) and payload[stop] & 0xC0 == 0x80:
            stop -= 1
        yield start, stop
        if stop >= len(payload):
            return
        start = stop


def records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, chunk: int = CHUNK_BYTES) -> Iterator[str]:
    """The records of one page, without the two line breaks that end each."""
    payload = (html or "").encode("utf-8", "replace")
    name = [("WARC-Date", _DATE)]
    if url is not None:
        name.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    whole = hashlib.sha256(payload).hexdigest()
    told = [("WARC-Payload-Digest", f"sha256:{whole}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        about = [("WARC-Type", "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record([*about, *name, *told, ("Content-Length", "0")], "")
        return
    running, parts = hashlib.sha256(), list(_cuts(payload, chunk))
    for number, (start, stop) in enumerate(parts, 1):
        part = memoryview(payload)[start:stop]
        running.update(part)
        if number == 1:
            about = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(page_id)), *name, *told, ("Content-Type", "text/html")]
        else:
            about = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page-segment:{page_id}:{number}>"), ("WARC-Segment-Origin-ID", _urn(page_id)), *name, *told]
        if len(parts) > 1:
            about.append(("WARC-Segment-Number", str(number)))
            if number == len(parts):
                about.append(("WARC-Segment-Total-Length", str(len(payload))))
        yield _record([*about, ("X-Running-Digest", f"sha256:{running.hexdigest()}"), ("Content-Length", str(stop - start))], str(part, "utf-8"))


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload an earlier page has; only narrow rows are shuffled."""
    html = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size"))
    narrow = narrow.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("other")).where("other > refers_to")
    return narrow.join(first.drop("other"), "digest").where("page_id > refers_to").distinct()


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzip archives below ``path``."""
    decided = revisits(pages, min_bytes)
    full = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    rows = full.join(decided, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            # a row for each page, since the writer starts new files between rows only: no page is cut by a file's end
            out = [(_BREAK * 2).join(records(*row, chunk=chunk)) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    lines = rows.mapInArrow(run, "value string")
    lines.write.option("lineSep", _BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a piece at a time."""
    view, at, member = memoryview(content), 0, zlib.decompressobj(31)
    while at < len(view):
        given = view[at : at + _UNPACK]
        piece = member.decompress(given)
        at += len(given)
        if piece:
            yield piece
        if member.eof:
            at -= len(member.unused_data)
            member = zlib.decompressobj(31)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Head and body pieces of every record; a body must be read before the next record is asked for."""
    held = bytearray()
    mark = (_BREAK * 2).encode()
    more = lambda: next(pieces, None)
    while True:
        while (end := held.find(mark)) < 0:
            piece = more()
            if piece is None:
                return
            held += piece
        fields = dict(line.split(": ", 1) for line in held[:end].decode().split(_BREAK)[1:])
        del held[: end + len(mark)]
        left = int(fields["Content-Length"])

        def body(left: int = left) -> Iterator[bytes]:
            while left:
                if not held:
                    held.extend(more() or b"")
                    if not held:
                        raise ValueError("the archive ends inside a record")
                part = bytes(held[:left])
                del held[: len(part)]
                left -= len(part)
                yield part
            while len(held) < len(mark):
                held.extend(more() or b"?")
            if held[: len(mark)] != mark:
                raise ValueError("a record's end is missing")
            del held[: len(mark)]

        yield fields, body()


def chunks(content: bytes) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` from one archive.  Segments of a record follow each other, so one running hash is enough."""
    running, seen, number, about = hashlib.sha256(), 0, 0, None
    for fields, body in parse(_unpacked(content)):
        kind = fields["WARC-Type"]
        if kind != "continuation":
            running, seen, number, about = hashlib.sha256(), 0, 0, fields
        elif about is None:
            raise ValueError("the archive starts inside a record")
        size = 0
        for part in body:
            running.update(part)
            size += len(part)
        seen, number = seen + size, number + 1
        told, total = about["WARC-Payload-Digest"].removeprefix("sha256:"), int(about["X-Payload-Length"])
        if about["WARC-Type"] == "revisit":
            yield _id_of(about["WARC-Record-ID"]), 1, 0, told, True, "revisit", _id_of(about["WARC-Refers-To"]), total, told
        else:
            if running.hexdigest() != fields["X-Running-Digest"].removeprefix("sha256:"):
                raise ValueError(f"a segment of {about['WARC-Record-ID']} is damaged")
            yield _id_of(about["WARC-Record-ID"]), number, size, running.hexdigest(), seen == total, "response", None, seen, told


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives below ``path``."""
    schema = pa.schema([("page_id", pa.int64()), ("chunk_no", pa.int32()), ("chunk_bytes", pa.int64()), ("running_digest", pa.string()), ("last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("declared_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = list(zip(*chunks(content.as_py()), strict=True))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, CHUNKS)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    whole = read_archives(spark, path).where("last")
    return whole.select("page_id", "payload_bytes", F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")


OP4_SQL = """
with payloads as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as size, sha256(coalesce(html, '')) as digest from pages
), firsts as (
  select digest, min(page_id) as first from payloads where size >= 100 group by digest
)
select page_id, size as payload_bytes, p.digest as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from payloads p left join firsts f on p.digest = f.digest and p.size >= 100
"""
