"""WARC archives as a chunked record table.

Writing: every payload is cut into chunks of at most ``chunk_bytes``; the chunk rows (record identifier,
chunk number) become WARC records, the first a ``response``, the rest ``continuation`` segments, so no
archive record grows with its payload.  Spark's text writer joins them with CRLF, which works in
any store Spark can write to; gzip keeps a file unsplittable, hence in order.  Reading: the lines of each
file stream through a parser that yields chunk rows with running offset and running SHA-1, holding one chunk
at a time.  A chunk that does not follow its predecessor raises an error instead of giving a wrong digest.

Duplicates: of equal payloads the smallest page_id is written as ``response`` and the others as
``revisit`` records (headers only) that refer to it.

Defined cases: a null html is the empty payload; a null page_id is written as ``null`` and read back as null;
it is a revisit if a page with an id has its payload, else a response; rows repeating the smallest page_id
are responses, each; null urls are left out and CR or LF in a url is percent-encoded; extra columns are ignored;
an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import b32_sha1, materialize, table, text_bytes
from keelson.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 20
CRLF = "\r\n"
RECORD_URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"

CHUNK_SCHEMA = ("record_id string, page_id bigint, record_type string, url string, refers_to bigint, chunk_no int, "
                "chunk_offset bigint, chunk binary, running_sha1 string, is_last boolean, "
                "payload_bytes bigint, payload_digest string")


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and its digest, and the page that carries the payload (null: this one)."""
    rows = pages.select("page_id", "url", text_bytes(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", b32_sha1(F.col("payload")))
    # one small row per payload, combined before the shuffle; written, so that the join below can split hot digests
    firsts = materialize(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
                         .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select(F.col("digest").alias("d"), "first_id"), "warc-firsts")
    joined = rows.join(firsts, F.col("digest") == F.col("d"), "left")
    own = F.col("first_id").isNull() | F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(~own, F.col("first_id")).alias("refers_to"))


def _uri(page_id: Column, segment: Column | None = None) -> Column:
    base = F.concat(F.lit(RECORD_URN), F.coalesce(page_id.cast("string"), F.lit("null")))
    return base if segment is None else F.concat(base, F.lit("#"), segment.cast("string"))


def _lines(*lines: Column) -> Column:
    """Header lines joined by CRLF; null lines are left out."""
    return F.concat_ws(CRLF, *lines)


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = 0,
                   compression: str = "gzip") -> None:
    """Write one response or revisit record per row (plus continuation segments) as WARC files under ``path``."""
    rows = with_originals(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")
    chunks = F.when(revisit | (size == 0), F.array(F.lit(b""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((size - 1) / chunk_bytes).cast("int")),
                    lambda i: F.substr(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes))))
    rows = rows.select("page_id", "url", "digest", "refers_to", size.alias("size"), F.size(chunks).alias("n"),
                       F.posexplode(chunks).alias("no", "chunk"))
    page, first, split = F.col("page_id"), F.col("no") == 0, F.col("n") > 1
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.when(first, F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
                                  F.col("size").cast("string"), F.lit(CRLF * 2))).otherwise(F.lit(""))
    header = _lines(
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <"), F.when(first, _uri(page)).otherwise(_uri(page, F.col("no") + 1)), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.when(first, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), _uri(F.col("refers_to")), F.lit(">"))),
        F.when(split, F.concat(F.lit("WARC-Segment-Number: "), (F.col("no") + 1).cast("string"))),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: <"), _uri(page), F.lit(">"))),
        F.when(split & (F.col("no") == F.col("n") - 1), F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("size").cast("string"))),
        F.when(first, F.lit("Content-Type: application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), (F.octet_length("chunk") + F.octet_length(http)).cast("string")),
    )
    record = F.concat(F.concat(header, F.lit(CRLF * 2), http).cast("binary"), F.col("chunk"), F.lit(CRLF).cast("binary"))
    # the writer's line end completes the two CRLF after the block
    rows.select(record.cast("string").alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


def _b32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _page(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(RECORD_URN)
    return int(text) if text.lstrip("-").isdigit() else None


def _records(lines: Iterable[bytes], chunk_bytes: int) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """(headers, content length, block pieces) of each record; the pieces must be used up before the next record."""
    lines = iter(lines)
    for line in lines:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"expected a WARC version line, got {line[:60]!r}")
        headers: dict[str, str] = {}
        for field in lines:
            if not field:
                break
            name, _, value = field.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])

        def block(left: int = length) -> Iterator[bytes]:
            for piece in lines:
                if len(piece) > left:
                    raise ValueError("a record's block is longer than its Content-Length")
                left -= len(piece)
                yield piece
                if not left:
                    return
                yield b"\r\n"
                left -= 2
            raise ValueError("an archive ends within a record")

        pieces = block()
        yield headers, length, pieces
        for _ in pieces:
            pass


def parse_chunks(lines: Iterable[bytes], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of the records in ``lines`` (a file's CRLF-separated lines, in order)."""
    origin: str | None = None  # the record whose segments are being read
    expect, sha, offset, number, row0 = 1, hashlib.sha1(), 0, 0, ()
    for headers, _, pieces in _records(lines, chunk_bytes):
        kind, uri = headers.get("warc-type"), headers.get("warc-record-id", "")
        segment = int(headers.get("warc-segment-number", "1"))
        if kind == "continuation":
            if headers.get("warc-segment-origin-id") != origin or segment != expect:
                raise ValueError(f"segment {segment} of {headers.get('warc-segment-origin-id')} does not follow its predecessor")
        elif kind in ("response", "revisit"):
            if origin is not None and expect > 1:
                raise ValueError(f"the last segment of {origin} is missing")
            origin, sha, offset, number = uri, hashlib.sha1(), 0, 0
            row0 = (uri.strip("<>"), _page(uri), kind, headers.get("warc-target-uri"), _page(headers.get("warc-refers-to")))
        else:
            continue  # warcinfo, request and other records carry no payload
        full, head = None, kind != "continuation"
        line: list[bytes] = []
        buffer, held = [], 0
        for piece in pieces:
            if head:  # the HTTP header ends with an empty line
                if piece == b"\r\n":
                    text = b"".join(line)
                    line = []
                    if text.lower().startswith(b"content-length:"):
                        full = int(text.split(b":", 1)[1])
                    head = bool(text)
                else:
                    line.append(piece)
                continue
            for at in range(0, len(piece), chunk_bytes):
                part = piece[at:at + chunk_bytes]
                if held and held + len(part) > chunk_bytes:
                    body = b"".join(buffer)
                    sha.update(body)
                    yield (*row0, number, offset, body, _b32(sha), False, None, None)
                    number, offset, buffer, held = number + 1, offset + len(body), [], 0
                buffer.append(part)
                held += len(part)
        body = b"".join(buffer)
        sha.update(body)
        more = "warc-segment-number" in headers and "warc-segment-total-length" not in headers
        expect = segment + 1 if more else 1
        end = offset + len(body)
        total, digest = (full, headers.get("warc-payload-digest", "").removeprefix("sha1:")) if kind == "revisit" else (end, _b32(sha))
        yield (*row0, number, offset, body, _b32(sha), not more, None if more else total, None if more else digest)
        number, offset = number + 1, end
    if expect > 1:
        raise ValueError(f"the last segment of {origin} is missing")


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives under ``path``; without ``payloads`` only offsets and digests are kept.

    ``chunk_no`` and ``running_sha1`` belong to the payload up to and with the chunk; the row with ``is_last``
    holds the record's ``payload_bytes`` and ``payload_digest`` (a revisit's are those its headers state).
    """
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]]
             for c in CHUNK_SCHEMA.split(", ")]
    schema = pa.schema(list(zip(names, types)))

    def parse(batches):
        rows, held = [], 0
        for row in parse_chunks((line.as_py() for batch in batches for line in batch.column(0)), chunk_bytes):
            held += len(row[7])
            rows.append(row if payloads else (*row[:7], None, *row[8:]))
            if len(rows) >= 4096 or (payloads and held >= 16 * chunk_bytes):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(parse, CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from the chunk that completes it: no shuffle and no payload."""
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op1_warc_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keelson-warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return records(read_chunks(spark, path, payloads=False))


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    for g in range(8) for shift in (15, 10, 5, 0))

SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, url, body, strlen(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, url
FROM d
"""
